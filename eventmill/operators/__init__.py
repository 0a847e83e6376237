"""DataFrame-to-DataFrame operators, made for `df.transform(...)`."""
