"""Molecules of equal SMILES are read and worked on once in a job, spread over its tasks."""

import pytest
from pyspark.sql import functions as F

from ringwork.operators.atom_pair import AtomPairFingerprint
from ringwork.operators.torsion import TopologicalTorsionFingerprint
from ringwork.operators.values import as_slice
from ringwork.plans.queries import QUERIES
from ringwork.sources.prepare import once_each, prepare

SF = "/root/testdata/sf0.001"


def test_each_smiles_once_over_several_tasks(spark):
    texts = [f"C{k}" for k in range(40)] + [None]
    rows = spark.createDataFrame([(i, texts[i % 41]) for i in range(410)], "mol_id bigint, smiles string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def work(df):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema).withColumn("task", F.spark_partition_id()).where("smiles is null or smiles <> 'C7'")

    got = once_each(rows, work).collect()
    assert seen.value == 41
    assert len({r.task for r in got}) > 1
    assert sorted(r.mol_id for r in got) == [i for i in range(410) if texts[i % 41] != "C7"]
    assert all(r.smiles == texts[r.mol_id % 41] for r in got)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ("mol_smiles", "smiles_guarded")])
def test_queries_deal_molecules_over_the_tasks(name, spark):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan


def test_slice_of_counts_has_no_search_for_each_place(spark):
    kind = "fp struct<len:int,counts:array<struct<bit:int,cnt:bigint>>>"
    rows = [(((2048, [(0, 3), (1, 1), (900, 2), (2047, 5)])),), ((4, []),), ((0, []),), ((3, [(7, 1), (1, 2)]),), (None,)]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    got = [r.x for r in df.select(as_slice(F.col("fp")).alias("x")).collect()]
    whole = [0] * 2048
    whole[0], whole[1], whole[900], whole[2047] = 3, 1, 2, 5
    assert got == [whole, [0] * 4, [], [0, 2, 0], []]
    assert "sequence(" not in df.select(as_slice(F.col("fp")))._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(
    ("fp", "names"),
    [
        (AtomPairFingerprint(), ["__pi"]),
        (TopologicalTorsionFingerprint(), ["__end", "__inner"]),
        (TopologicalTorsionFingerprint(only_shortest_paths=True), ["__dist", "__end", "__inner"]),
    ],
)
def test_arrays_that_lambdas_look_up_are_made_once(fp, names, spark):
    df = prepare(spark.createDataFrame([("CCO",)], "smiles string"))
    plan = fp.compute(df).select("fp")._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"AS {name}#" in plan for name in names)


def test_rollup_takes_layers_not_bits(spark):
    plan = QUERIES["fp_layer_rollup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan and "counts" not in plan.split("Join")[0]
