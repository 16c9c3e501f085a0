"""What may cross to the side that scores: ids, attributes, integers and functional keys, nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame

WIRE = "query_id bigint, attrs array<string>, q array<bigint>, sk binary"
_KINDS = dict(c.split(" ") for c in WIRE.split(", "))


def check_wire(requests: DataFrame) -> DataFrame:
    """`requests` itself if it has exactly the columns of WIRE with their types; floats and texts cannot pass."""
    kinds = dict(requests.dtypes)
    if set(kinds) != set(_KINDS):
        raise ValueError(f"a request holds {sorted(_KINDS)}, not {sorted(kinds)}")
    for name, kind in kinds.items():
        if kind != _KINDS[name]:
            raise ValueError(f"{name} is {kind}, not {_KINDS[name]}")
    return requests
