"""Parsers: one file to rows of chunks. Python by the standard library's syntax tree, the brace languages by a scanner
that blanks out strings and comments first, markup by expat."""
