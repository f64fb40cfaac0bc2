"""Training-data operators: thirteen Spark jobs over documents and embeddings, each in its own module.

Nothing outside this subpackage imports it; ``queries`` holds the driver's
``opN_*`` queries and their SQL twins.
"""
