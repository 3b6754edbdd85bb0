"""Training-data operators: each module holds one operator, :mod:`.queries` registers them."""
