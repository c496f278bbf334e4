"""Training-data operators: ten stand-alone operators over document tables.

Nothing outside this subpackage imports it.  Text kernels work on Arrow
batches with numpy, so no operator runs Python code once per row or word
unless its docstring says so.
"""
