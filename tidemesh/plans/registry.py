"""Names of the flood-relief queries, with the SQL that states each result."""

from tidemesh.plans import queries as _queries
from tidemesh.plans.oracles import ORACLES

FLAGSHIP = "a7_reach_summary"
QUERIES = {name: f for name, f in vars(_queries).items() if name[:1] in "sptjrawufq" and name[1:2].isdigit() and callable(f)}

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
