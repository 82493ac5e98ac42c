"""Headline queries over the molecules derived from part: one line of JSON. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ringwork.operators.atom_pair import AtomPairFingerprint
from ringwork.operators.ecfp import CountEcfpFingerprint, EcfpFingerprint, LayeredCountEcfpFingerprint
from ringwork.operators.maccs import MaccsFingerprint
from ringwork.operators.torsion import TopologicalTorsionFingerprint
from ringwork.runtime import scratch
from ringwork.sources.prepare import prepare
from ringwork.sources.readers import molecules

# Radius and size of the cases, and sizes, so that figures can be compared.
CASES = [(0, 64), (1, 128), (2, 128), (2, 2048), (4, 2048), (5, 2048), (5, 4096)]
SIZES = [64, 256, 1024, 4096]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - start, 3)

    raw, ready = scratch(spark, "bench-raw"), scratch(spark, "bench-mol")
    source = molecules(spark, sf_dir).repartition(2 * int(cpus))
    timed("prepare", lambda: prepare(source).write.parquet(ready))
    timed("prepare_raw", lambda: prepare(source, normalized=False).write.parquet(raw))
    mols, raws = spark.read.parquet(ready), spark.read.parquet(raw)
    runs = {f"ecfp_bits_r{r}_n{n}": EcfpFingerprint(r, n) for r, n in CASES} | {f"ecfp_counts_r{r}_n{n}": CountEcfpFingerprint(r, n) for r, n in CASES}
    runs |= {"ecfp_layered_r2_n2048": LayeredCountEcfpFingerprint(), "maccs": MaccsFingerprint()}
    for name, fp in runs.items():
        timed(name, lambda fp=fp: fp.compute(mols).select("mol_id", "fp").write.format("noop").mode("overwrite").save())
    for n in SIZES:
        timed(f"atom_pair_raw_n{n}", lambda n=n: AtomPairFingerprint(n).compute(raws).select("mol_id", "fp").write.format("noop").mode("overwrite").save())
        timed(f"torsion_raw_n{n}", lambda n=n: TopologicalTorsionFingerprint(n).compute(raws).select("mol_id", "fp").write.format("noop").mode("overwrite").save())
    rows, distinct = mols.count(), source.select("smiles").distinct().count()
    rates = {k: round(rows / s) for k, s in took.items()}
    print(json.dumps({"metric": "molecular fingerprints over derived molecules, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "molecules": rows, "distinct_smiles": distinct, "molecules_per_sec": rates, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
