"""The registered queries of the signal and sequence operators, and the same in DuckDB SQL."""

from . import records, signals

QUERIES = signals.QUERIES | records.QUERIES
ORACLE = signals.ORACLE | records.ORACLE | {"stream_chunks": signals.ORACLE["normalise_pm1"]}
flagship = signals.normalise_pm1
