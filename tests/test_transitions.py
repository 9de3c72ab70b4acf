"""The batch generation hook runs a user scorer over Arrow batches."""

import pandas as pd


def test_simulate_hook(spark):
    from chronotok.operators.transitions import simulate

    hist = spark.createDataFrame([(1, [4, 5, 6]), (2, [7])], "person_id long, tokens array<int>")

    def scorer(pdf, n, m):
        rows = [(pid, s, i, int(t[-1]) + i) for pid, t in zip(pdf.person_id, pdf.tokens) for s in range(n) for i in range(m)]
        return pd.DataFrame(rows, columns=["person_id", "sim_id", "pos", "token_id"]).astype(
            {"person_id": "int64", "sim_id": "int32", "pos": "int32", "token_id": "int32"})

    out = simulate(hist, scorer, num_samples=2, max_new_tokens=3).collect()
    assert len(out) == 2 * 2 * 3
    assert {(r.person_id, r.sim_id, r.pos, r.token_id) for r in out if r.person_id == 2 and r.sim_id == 1} == {
        (2, 1, 0, 7), (2, 1, 1, 8), (2, 1, 2, 9)}
