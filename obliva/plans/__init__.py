"""Views over the driver's tables that give every operator an input of its own shape."""
