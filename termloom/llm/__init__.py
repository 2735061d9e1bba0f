"""Training-data operators; nothing else in termloom imports this subpackage."""
