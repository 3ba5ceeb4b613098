"""Distribution-aware DataFrame operators shared by every plan."""
