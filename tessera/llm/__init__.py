"""Operations of a training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and the names of its id and text columns, reads only those columns (so extra
or clashing columns never matter) and states in its docstring what nulls,
empty texts, ties and repeated rows give.
"""
