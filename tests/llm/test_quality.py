"""Statistics, boosted trees, held-out accuracy of the classifier."""

import os

import numpy as np
import pytest

from lakeloom.llm import quality as Q
from lakeloom.llm.boosting import train
from lakeloom.llm.holdout import EXAMPLES
from lakeloom.session import cut

DATA = "/root/testdata"


def docs(spark, texts):
    return spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, n_words string")


def test_statistics(spark):
    r = Q.statistics(docs(spark, ["The cat sat. It purred!\n- a, b\r\n", None, "", " ​", "x" * 300_000])).orderBy("doc_id").collect()
    assert r[0]["n_lines"] == 2 and r[0]["n_words"] == 7 and abs(r[0]["punct_line_share"] - 0.5) < 1e-9 and r[0]["bullet_share"] == 0.5 and r[0]["has_text"]
    assert [x["has_text"] for x in r] == [True, False, False, True, True] and r[1]["mean_word"] == 0 and r[4]["longest_token"] == 300_000


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ["a" if r[0] > 0.3 else "b" if r[1] > 0 else "c" for r in x]
    m = train(x[:400], y[:400], ["a", "b", "c", "never"])
    p = m.probabilities(x[400:])
    assert (np.array(m.classes)[p.argmax(1)] == np.array(y[400:])).mean() > 0.95 and np.allclose(p.sum(1), 1) and p[:, 3].max() < 0.01
    raw = -np.log(p[np.arange(200), [m.classes.index(c) for c in y[400:]]]).mean()
    assert m.calibrate(x[400:], y[400:]) <= raw + 1e-9
    assert train(np.zeros((0, 4)), [], ["a", "b"]).probabilities(np.zeros((1, 4))).shape == (1, 2)


@pytest.fixture(scope="module")
def corpus(spark):
    """Weakly labelled training texts that share no text with the held-out examples."""
    out = []
    for n in range(40):
        w = ["lamp", "table", "river", "cloud", "stone", "paper", "glass", "field"]
        a, b, c = w[n % 8], w[(n + 3) % 8], w[(n * 5 + 1) % 8]
        out += [
            f"The {a} was on the {b}, and nobody had seen it before the {c} came. It is not clear what they wanted, but all of them left when the sun was down.", f"We moved the {a} to a\nbetter place, because the {b} is\ntoo wet for it. The {c} can stay\nwhere it was for now.",
            "\n".join(f"- {x} {n}" for x in w[n % 3 :]), f"{a} things\n" + "\n".join(f"{x} {y}" for x, y in zip(w, w[1:], strict=False)), "\n".join(f"{k}) {x};" for k, x in enumerate(w)), f"Some {a} words that are said before it.\n" + "\n".join(f"* {x} {c}" for x in w),
            "\n".join(f"{x},{k},{n},{k * n}" for k, x in enumerate(w)), "\n".join(f"{x} | {k} | yes" for k, x in enumerate(w)), "\n".join(f"{x}\t{k}\tno\t-" for k, x in enumerate(w)), f"The {a} counts are these.\n" + "\n".join(f"{x};{k};{n}" for k, x in enumerate(w)), "\n".join(f"{x:<12}{k:>9}{n:>9}" for k, x in enumerate(w)),
            "\n".join(f"{k}. {x} {y}" for k, (x, y) in enumerate(zip(w, w[1:], strict=False), 1)), "\n".join(f"{x} {b}." for x in w), f"{a} | count | state\n---|---|---\n" + "\n".join(f"| {x} | {k} | {n} |" for k, x in enumerate(w)),
            "; ".join("qxz vbn# trk wls kjd mnp"[(k * n) % 9 :] for k in range(6)), "#%&{} [;;] " * (n + 3), f"{a} " * 60, " | ".join(w[(k * n) % 8].title() for k in range(12)), " ".join("bcdfghjklmnpqrstvwxz"[(k * 7 + n) % 20] * 2 + "qk" + ";#"[k % 2] for k in range(40)), "\n".join("aB3/x9Q+" * 8 for _ in range(3)), "Ã©Â ï¿½ n" * (n + 9), "~*" * 30 + "\n" + "~*" * 30,
        ]
    return docs(spark, out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("table", "least"), [("sf0.01", 0.9), ("sf0.1", 0.95)])
def test_held_out_accuracy(spark, table, least):
    """Trained on weak labels of a documents table; the hand-checked examples only calibrate, which changes no decision."""
    model = Q.fit(cut(Q.statistics(spark.read.parquet(f"{DATA}/{table}/documents.parquet"))))
    held = Q.statistics(docs(spark, [t for _, t in EXAMPLES]))
    got = {r["doc_id"]: r["kind"] for r in Q.predict(held, model).collect()}
    right = sum(got[n] == k for n, (k, _) in enumerate(EXAMPLES))
    assert right >= least * len(EXAMPLES), [(k, got[n], t[:40]) for n, (k, t) in enumerate(EXAMPLES) if got[n] != k]


def test_training_rows_are_bounded_and_repeatable(corpus):
    s = Q.statistics(corpus)
    a, b = Q.fit(s, 200), Q.fit(s.repartition(3), 200)
    x = np.array([r[1:-1] for r in s.limit(20).collect()], dtype=float)
    assert np.allclose(a.probabilities(x), b.probabilities(x))


def test_blank_documents_have_no_kind(spark):
    assert Q.kinds(docs(spark, [None, "", " \n"])).count() == 0 and Q.kinds(docs(spark, ["x"]).limit(0)).count() == 0
