"""Tables of the memory model, and its file formats."""
