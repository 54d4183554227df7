"""Checks and counters in the pass that a query makes anyway: observed metrics, judged after the action."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Checked:
    """A table with named counters and checks. ``df`` is used as it is; after an action on it (or on what is made of it)
    ``counts`` gives the counters, and ``verify`` raises a ValueError that names each failed check with its number of rows. Rows that
    an action does not read (a limit, a filter pushed below) are not counted."""

    def __init__(self, df: DataFrame, name: str, failures: Mapping[str, Column], counters: Mapping[str, Column] | None = None):
        self.name, self.failures, self.observation = name, list(failures), Observation(name)
        metrics = [F.coalesce(F.count_if(v), F.lit(0)).alias(f"failed: {k}") for k, v in failures.items()]
        self.df = df.observe(self.observation, *metrics, *[v.alias(k) for k, v in (counters or {}).items()])

    def counts(self) -> dict[str, object]:
        return {k: v for k, v in self.observation.get.items() if not k.startswith("failed: ")}

    def verify(self) -> None:
        found = self.observation.get
        bad = [f"{k} ({found[f'failed: {k}']} rows)" for k in self.failures if found[f"failed: {k}"]]
        if bad:
            raise ValueError(f"{self.name}: {', '.join(bad)}")


class Layers:
    """Results of several layers as one table with the column layer, read once: ``verify`` raises a ValueError that names the layers
    whose keys (as places, or times) or lengths of ``x`` are not those of the first."""

    def __init__(self, layers: Mapping[str, DataFrame], key: list[str], x: str):
        self.parts, out = {}, None
        for name, df in layers.items():
            rows = df.select(F.lit(name).alias("layer"), *key, F.col(x).alias(x))
            # a digest that does not depend on the order of rows: the keys' hashes, added and crossed
            h = F.xxhash64(*key)
            seen = {"rows": F.count("*"), "sum": F.sum(h.cast("decimal(20,0)")), "crossed": F.bit_xor(h), "shortest": F.min(F.size(x)), "longest": F.max(F.size(x))}
            self.parts[name] = Checked(rows, f"layer {name}", {}, seen)
            out = self.parts[name].df if out is None else out.unionByName(self.parts[name].df)
        self.df, self.key = out, key

    def verify(self) -> None:
        found = {name: part.counts() for name, part in self.parts.items()}
        first, *rest = found
        bad = [f"{n}: lengths {c['shortest']} to {c['longest']}" for n, c in found.items() if c["shortest"] != c["longest"]]
        for n in rest:
            a, b = found[first], found[n]
            if any(a[k] != b[k] for k in ("rows", "sum", "crossed")):
                bad.append(f"{n}: {', '.join(self.key)} of {b['rows']} rows are not those of {first} ({a['rows']})")
            if a["longest"] != b["longest"]:
                bad.append(f"{n}: length {b['longest']}, of {first} {a['longest']}")
        if bad:
            raise ValueError("; ".join(bad))
