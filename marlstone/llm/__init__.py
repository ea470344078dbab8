"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Rules that hold for every operator
here, unless its docstring says otherwise:

* only the columns named in the signature are read; further input columns are
  carried along untouched, and one that has the name of an output column is
  replaced by that output;
* a null text counts as the empty text;
* rows are never dropped, capped or sampled to escape skew;
* intermediate tables are written below ``spark.checkpoint.dir`` so that a
  lost executor costs a task, not the job.
"""
