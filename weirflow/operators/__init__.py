"""What pipes are made of."""

from .elements import Filter, FlatMap, Map, PyFlatMap, PyMap, Row, kv, pair
from .join import JoinFlatMapByKey, PyJoinFlatMapByKey
from .reduce import Counted, FoldReduce, PyFoldReduce, Python, Reduce, ReduceByKey, WindowByKey

__all__ = ["Counted", "Filter", "FlatMap", "FoldReduce", "JoinFlatMapByKey", "Map", "PyFlatMap", "PyFoldReduce", "PyJoinFlatMapByKey", "PyMap", "Python", "Reduce", "ReduceByKey", "Row", "WindowByKey", "kv", "pair"]
