import random

from colinear.plans import programs


def covered(found) -> int:
    return len({k for x in found.collect() for k in range(x["t_start"], x["t_start"] + x["len"])})


def test_search_goes_on_past_the_seeded_pixel(spark):
    """One exact seed, then 1500 letters with a change every ten: only neighbours of searched pixels lead there."""
    r = random.Random(17)
    genome = "".join(r.choice("ACGT") for _ in range(2400))
    part = list(genome[300:2000])
    for k in range(100, 1700, 10):
        part[k] = "ACGT"[("ACGT".index(part[k]) + 1) % 4]
    target = spark.createDataFrame([(0, genome)], "seq_id long, seq string")
    query = spark.createDataFrame([(0, "".join(part))], "seq_id long, seq string")
    assert covered(programs.synteny_search(query, target, (15,), t_chunk=256, q_chunk=256)) > 1500


def test_search_leaves_no_pixel(spark):
    """40 targets with a seed each: more than ten rounds of one pixel."""
    r = random.Random(18)
    rows, parts = [], []
    for k in range(40):
        s = "".join(r.choice("ACGT") for _ in range(300))
        far = "".join(c if j % 10 else "ACGT"[("ACGT".index(c) + 1) % 4] for j, c in enumerate(s[100:]))
        rows.append((k, s))
        parts.append((k, s[60:100] + far))
    target = spark.createDataFrame(rows, "seq_id long, seq string")
    query = spark.createDataFrame(parts, "seq_id long, seq string")
    found = programs.synteny_search(query, target, (15,), per_round=1)
    assert found.where("len > 150").select("target_id").distinct().count() == 40
