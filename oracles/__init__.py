"""DuckDB SQL per query, used only to check results."""

from oracles import analysis, classification, reporting, streams

ORACLES = {**classification.SQL, **analysis.SQL, **reporting.SQL, **streams.SQL}
