"""Training-data preparation operators; nothing outside this package imports them."""
