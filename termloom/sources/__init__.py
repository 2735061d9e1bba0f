"""Binary files of an inverted index: byte cursors, record layouts, and readers and writers over DataFrames."""
