"""Operators of a training-data pipeline over a ``documents`` table.

One module per operator, ``queries`` registers them. Nothing else in the
library imports this package.

Common rules. An operator takes a DataFrame and the names of its id and text
columns and reads no other column, so extra columns may have any name. It
returns the id and its own result columns. A null text counts as an empty
one, a null id is carried along, an empty table gives an empty result of the
same schema. Intermediate tables are written below ``spark.checkpoint.dir``.
"""
