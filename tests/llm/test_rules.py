import random
import re
import string

import duckdb
import pyarrow as pa
from fluxlane.llm import rules
from samples import ODD, words


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    places = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def texts():
    rng = random.Random(6)
    made = [words(rng, rng.randint(0, 60), ["a", "b", "c"]) for _ in range(40)]
    made += ["".join(rng.choice("ab \n\t#|é") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    return [*made, "a b c a b c", "a a a a", "a a a", "x y z\x1fw", string.punctuation, "line\nline\n\nline\n \n "]


def test_base_counts_equal_brute_force(spark, make_docs):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in rules.verdicts(make_docs(rows)).collect()}
    for i, t in rows:
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_oracle_agrees_on_odd_texts(spark, make_docs):
    rows = [*enumerate(texts()), *[(1000 + i, t) for i, (_, t) in enumerate(ODD) if "\x00" not in (t or "")]]
    rows += [(2002 + n, "Home page | " * n + "word " * n + ", all rights reserved, click here" * (n % 3)) for n in range(1, 90)]
    rows += [(2000, "Home | About | Contact\n" + "Good sentence with words. " * 30), (2001, "Copyright notice. All rights reserved\n" * 40 + words(random.Random(1), 80))]
    got = sorted((tuple(r) for r in rules.verdicts(make_docs(rows)).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    assert got == sorted(con.execute(rules.ORACLE).fetchall(), key=str)


def test_lines_that_fail(spark):
    menu = "Home page | " * 30 + "Contact the shop"
    lines = {
        menu: False, menu + "x" * 400: False, "Some prose, with a | bar in it.": True, "One | two | three.": False, "| thirteenth | fourteenth | fifteenth |": False,
        "aaaa bbbbbbbbb | cccc dddddddddd | a sentence that goes on for some time, longer than any entry.": True,
        "Prose of many words. " * 30 + "Copyright law.": True, "x " * 180 + "y. All rights reserved. All rights reserved.": False,
        "A sound sentence, as people write it.": True, "Home | About | Contact | Help": False, "next > previous > top": False, "All Rights Reserved 2020.": False, "*** ### $$$ go": False,
        "1234 5678": False, "Short heading": True, "one two three four five six seven eight nine ten": False, "He said: all is well with the new house": True,
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: r.ok for r in df.select("line", rules.line_passes(rules.F.col("line")).alias("ok")).collect()} == lines


def test_documents_that_lose_too_much_are_rejected(make_docs):
    rng = random.Random(8)
    good = "\n".join(words(rng, 12).capitalize() + "." for _ in range(10))
    bad = "\n".join(f"{words(rng, 2)} | {words(rng, 2)} | {words(rng, 2)}"[:60] for _ in range(60))
    got = {r.doc_id: r for r in rules.clean(make_docs([(1, good), (2, good + "\n" + bad), (3, good + "\nHome | About | Help")])).collect()}
    assert got[1].kept and got[1].clean_text == good and not got[2].kept and not got[2].base_failed
    assert got[3].kept and got[3].clean_text == good


def test_odd_and_empty_tables(make_docs):
    assert len(rules.verdicts(make_docs(ODD)).collect()) == len(ODD)
    assert rules.verdicts(make_docs([])).collect() == []


def test_long_texts_take_no_time_squared(make_docs):
    rng = random.Random(2)
    text = words(rng, 60_000) + "\n" + "x" * 300_000
    r = rules.verdicts(make_docs([(1, text)])).collect()[0]
    assert r.n_words == 60_001


def test_main_path_is_native(spark, make_docs):
    plan = rules.verdicts(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
