import pyarrow.parquet as pq

from tallyfold.llm import preferences as op
from pyspark.sql import functions as F


def brute(turns):
    """Rows of (conv_id, turn, role, text) to pairs."""
    sides = {}
    for conv, turn, role, text in turns:
        pair = None if conv is None else conv // 2
        key = (turn is not None, turn or 0, role or "", text or "")
        sides.setdefault(pair, ([], [], [None], [None]))[conv is not None and conv % 2].append(key)
        sides[pair][2 + (conv is not None and conv % 2)][0] = conv
    safe = lambda s: s.replace("<|", "<||")
    out = []
    for pair, (c, r, chosen, rejected) in sides.items():
        c, r = ([k[2:] for k in sorted(x)] for x in (c, r))
        n = next((i for i, (x, y) in enumerate(zip(c, r)) if x != y), min(len(c), len(r)))

        def render(ts):
            text, mask = "", []
            for role, said in ts:
                text += f"<|{safe(role)}|>\n"
                start = len(text)
                text += safe(said) + "<|end|>\n"
                if role == "assistant":
                    mask.append(f"{start}:{len(text)}")
            return text, ",".join(mask)

        (pc, mc), (pr, mr) = render(c[n:]), render(r[n:])
        out.append((pair, chosen[0], rejected[0], n, render(c[:n])[0], pc, pr, mc, mr))
    return sorted(map(repr, out))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()]
    got = op.digest_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows)


def test_prefixes_nulls_and_ties(spark):
    hello = [(0, "system", "be <|kind|>"), (1, "user", "hi"), (2, "assistant", "hello")]
    rows = [(4, *t) for t in hello] + [(5, *t) for t in hello]  # equal conversations
    rows += [(6, *t) for t in hello] + [(7, *t) for t in hello[:2]] + [(7, 2, "assistant", "go é😀 away"), (7, 3, "user", None)]
    rows += [(8, *t) for t in hello[:2]] + [(9, *t) for t in hello]  # one is a prefix
    rows += [(11, 0, "user", "alone"), (12, None, None, "x"), (12, 0, "assistant", "y" * 100000), (12, 0, "assistant", "z"), (12, 0, "assistant", "z")]
    rows += [(None, 0, "user", "nobody")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pair int").repartition(4)
    got = op.digest_rows(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows)
    assert {r.pair: r.n_common for r in got.collect()}[2] == 3
    assert op.digest_rows(df.limit(0)).count() == 0
    free = op.preference_pairs(df.filter("conv_id in (4, 7)"), F.lit("p"), F.col("conv_id") == 7).first()
    assert free.n_common == 2 and free.rejected_mask[0].start == len("<|assistant|>\n")
