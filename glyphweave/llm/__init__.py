"""Operations of a training-data pipeline: ten operators over document tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
