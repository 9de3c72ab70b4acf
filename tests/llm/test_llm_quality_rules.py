import random
import re
from collections import Counter

from llm_cases import documents, empty

from chronotok.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_features_equal_brute_force(spark):
    docs, rows = documents(spark)
    loop = "one two three four five six seven eight nine. " * 40
    more = [(100, loop), (101, loop + "\n" + loop), (102, "a b c d e f g h a b c d e f g h i"), (103, "x\x0by\x0cz\r\n\tw"),
            (104, "word " * 30000)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(tuple(r) for r in Q.judge(frame).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        .fillna(-1, ["doc_id"]).collect())
    want = []
    for i, t in rows + more:
        f = brute(t)
        want.append((-1 if i is None else i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert got == sorted(want)


def line(spark, text):
    prose = " ".join(f"word{i}" for i in range(30)) + "."
    r = Q.judge(spark.createDataFrame([(1, prose + "\n" + text + "\n" + prose.upper())], "doc_id long, text string")).first()
    assert r.clean_text.split("\n")[0] == prose and r.kept
    return r.n_lines_removed == 1


def test_line_rules(spark):
    assert line(spark, "Home | About | Contact | Login")
    assert line(spark, "Log in")
    assert line(spark, "BUY!! NOW!! CHEAP!!")
    assert line(spark, "some$$$ words%%% with*** marks###")
    assert line(spark, "All rights reserved.")
    assert line(spark, "We use cookies on this site.")
    assert line(spark, " ".join(f"w{i}" for i in range(12)))
    assert not line(spark, "A short heading")
    assert not line(spark, "Is this a question? Yes, it is!")
    assert not line(spark, "")


def cleaned(spark, text):
    return Q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().clean_text


def long(n, first="Alpha", last=""):
    return " ".join([first] + [f"beta{i}" for i in range(n - 2)] + ["gamma"]) + last


def test_marks_of_other_scripts_end_sentences(spark):
    for mark in ".!?\u2026\u037e\u0589\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u1367\u17d4\u3002\uff01\uff1f\uff61":
        assert not line(spark, long(14, last=mark)), hex(ord(mark))
    assert line(spark, long(14, last=";")) and line(spark, long(14, last="\u060c"))


def test_wrapped_prose_stays(spark):
    wrapped = [long(14), long(13, "delta"), long(12, "delta"), "delta and its end."]
    assert cleaned(spark, "\n".join(wrapped)) == "\n".join(wrapped)
    began = ["A short one. " + long(12), long(13, "delta")]  # the text stops inside the sentence
    assert cleaned(spark, "\n".join(began)) == "\n".join(began)
    hindi = " ".join(["\u0915\u0916"] * 13)
    assert cleaned(spark, hindi + "\n" + hindi + "\u0964") == hindi + "\n" + hindi + "\u0964"


def test_long_lines_that_are_not_wrapped_go(spark):
    end = "delta and its end."
    for text in (long(14) + "\n\n" + end, long(14) + "\nDelta and its end.", long(14) + "\nAll rights reserved.\n" + end,
                 "One sentence.\n" + long(14, "delta"), long(14)):
        left = cleaned(spark, text)
        assert "beta0" not in left, text
    far = [long(14)] + ["delta on"] * 4  # short lines are no part of a wrapped sentence
    assert cleaned(spark, "\n".join(far)) == ""
    for k, stays in ((8, True), (9, False)):
        text = "\n".join([long(14)] + [long(5, "delta")] * k + [end])
        assert (cleaned(spark, text) == text) == stays


def test_runs_of_short_lines_are_menus(spark):
    menu = ["Produkte", "\u00dcber uns", "Unsere neuen Preise", "Kontakt"]
    prose = "Here is a line of prose."
    assert cleaned(spark, "\n".join([prose, *menu, prose])) == prose + "\n" + prose
    assert cleaned(spark, "\n".join([prose, *menu * 3])) == prose
    for kept in (menu[:3], menu[:2] + [prose] + menu[2:], menu[:2] + [""] + menu[2:], [x + "." for x in menu]):
        assert cleaned(spark, "\n".join([prose, *kept])) == "\n".join([prose, *kept])


def test_links_and_copyright_lines(spark):
    assert line(spark, " https://example.org/a?b=c ") and line(spark, "www.example.org")
    assert line(spark, "\u00a9 2024 Example") and line(spark, "Copyright (C) 1999 by nobody.")
    assert not line(spark, "See https://example.org/ for more.") and not line(spark, "Points (c) and (d) hold.")


def test_lines_equal_the_sql(spark):
    import duckdb

    rng = random.Random(5)
    some = ["Home", "Menu entry", "one two three", "", "  ", "delta goes on here and on", "Delta goes on here and on", long(14),
            long(12, "delta"), long(11, "delta"), "It ends. And then goes on", "it ends here.", 'He said "so."', "he asked\u061f",
            "All rights reserved.", "a | b | c", "www.example.org", "\u00a9 2020 x", "\u0915\u0916 \u0915\u0964", "x" * 5, "WOW!! NOW!!",
            "some $$$ %%% text", "(end.)", "end.\"')) ", "end.)))) ", "\x0bvertical\x0c tab", "\u4e2d\u6587\u3002", "1. item", "d' accord"]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 30)))) for i in range(400)] + [(900, None), (901, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(Q.ORACLE_SQL)
    columns = [c[0] for c in want.description]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_many_lines_in_one_text(spark):
    text = "\n".join(["delta goes on here and on", long(12, "delta")] * 30000)
    assert cleaned(spark, text).count("\n") == 29999


def test_verdict(spark):
    prose = "\n".join(" ".join(f"w{i}x{j}" for i in range(15)) + "." for j in range(4))
    junk = "\n".join(" | ".join(f"m{i}x{j}" for i in range(15)) for j in range(6))
    rows = [(1, prose), (2, prose + "\n" + junk), (3, "too short."), (4, None), (5, "")]
    got = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_clean_keeps_all_columns(spark):
    docs, _ = documents(spark)
    out = Q.clean(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in Q.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in out.collect()} == kept
    assert Q.clean(empty(spark)).count() == 0 and Q.judge(empty(spark)).count() == 0


def test_main_path_has_no_python_and_no_shuffle(spark):
    plan = Q.judge(documents(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
