"""Training-data operators: ten distributed steps that prepare a text corpus for language models.

Nothing else in the library imports this subpackage. ``registry`` lists its queries and SQL.
"""
