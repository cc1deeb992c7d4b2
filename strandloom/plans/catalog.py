"""Every query of the library with its DuckDB counterpart, by the names of the blueprint."""

from strandloom.plans import graphs, placement, reads

QUERIES = {**reads.QUERIES, **graphs.QUERIES, **placement.QUERIES}
ORACLES = {**reads.ORACLES, **graphs.ORACLES, **placement.ORACLES}
