"""Streaming jobs built from the batch operators.

Every sink writes the rows of a batch into a folder of that batch and replaces
the folder if the batch runs again, so a restart neither loses nor repeats rows.
"""
