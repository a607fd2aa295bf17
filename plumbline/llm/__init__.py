"""Operations of a training-data pipeline: ten operators and their registered queries.

Nothing else in the library imports this subpackage. Every operator is a function on
DataFrames with its own column parameters; the ``op<N>_<name>`` queries in
:mod:`plumbline.llm.queries` apply them to the whole given tables.
"""
