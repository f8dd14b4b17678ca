"""Operators of a training-data pipeline over documents and web pages.

Nothing outside this subpackage imports it. ``registry`` lists its queries;
``__spark_entry__.py`` adds them when the subpackage is present.
"""
