"""A relational vocabulary of records on Spark: fields, headers, streams, joins, aggregates and analytic functions."""

from .field import Field, FieldPin, Header
from .ordering import asc, desc
from .record import FieldCycleError, Record
from .recordset import RecordSet
from .stream import Aux, RecordStream

__all__ = ["Aux", "Field", "FieldCycleError", "FieldPin", "Header", "Record", "RecordSet", "RecordStream", "asc", "desc"]
