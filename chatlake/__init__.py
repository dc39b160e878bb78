"""chatlake: chat-corpus processing as plain Spark DataFrame transformations.

Every operator is a function ``DataFrame -> DataFrame`` (or a few DataFrames in,
one out) so that pipelines chain with ``DataFrame.transform``.  Nothing here
collects rows to the driver; per-owner / per-thread sequential rules are
expressed with windows, joins and bounded SQL higher-order functions.
"""

__all__ = ["session"]
