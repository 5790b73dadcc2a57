"""Tables in, files out."""
