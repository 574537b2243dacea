import hashlib
import re

from fluxlane.llm import catalog, secrets
from samples import ODD

KEY, OPAQUE = "AKIA" + "Q7" * 8, "aB3" * 12


def brute(text):
    """The contract's spans, by trying each place from the left."""
    text, out = text or "", []
    for kind, pattern, least in (("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        at = 0
        while m := re.compile(pattern).search(text, at):
            at = m.end()
            if (len(m[2]) >= 6) if least is None else len(m[0]) >= least:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


TEXTS = [
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "secret: token: abcdefgh", "PassWord=abc password:abcdef apikey='zzzzzz' API_KEY = q1w2e3", "AKIAAKIA" + "A" * 20, "AKIA" + "B" * 15 + "c",
    "é" * 40 + " secret=Key123456 tokſ=abcdef", "0" * 23 + " " + "f" * 24 + "g" + "a" * 30, "token=secret=abcdefgh token=abc.", "", None,
]


def test_certain_spans_equal_brute_force():
    for t in TEXTS:
        assert secrets.base_spans(t or "") == brute(t)


def kinds(text):
    base, every = secrets.find_spans(text)
    assert set(base) <= set(every) and every == sorted(every, key=secrets._order)
    return [k for _, _, k in every]


def test_weak_parts_need_their_complement():
    assert kinds(f"lone {OPAQUE} here") == []
    assert kinds(f"host=db.example.com user=admin") == []
    assert kinds(f"{KEY} and {OPAQUE}") == ["access", "opaque"]
    assert kinds(f"user=admin {OPAQUE} host=db.example.com") == ["ident", "opaque", "endpoint"]
    assert kinds("user=admin password=hunter22 https://db.example.com/x") == ["ident", "assign", "endpoint"]
    assert kinds(f"{KEY}\n\n{OPAQUE}") == ["access"]  # another scope
    assert kinds(f"{KEY} {'w ' * 4000}{OPAQUE}") == ["access", "opaque"]  # far apart in one scope
    assert kinds(f"{OPAQUE}\n\nuser=admin {OPAQUE}\n \nhost=db.example.com") == ["ident", "opaque"]
    assert kinds("see https://www.example.com/ for " + "words " * 20) == []


def test_hex_runs_are_secrets_of_identifiers():
    run = "0f" * 16
    assert kinds(f"user=admin {run} host=db.example.com") == ["ident", "hex", "endpoint"]
    assert kinds(f"{run}") == ["hex"] and kinds(f"user=admin\n\n{run}") == ["hex"]
    assert secrets.redact(f"user=admin {run}") == "[IDENT] [HEX]"


def test_interval_join_equals_all_pairs():
    import random

    rng = random.Random(2)
    for _ in range(300):
        spans = sorted((s, s + rng.randint(1, 900), "ident") for s in (rng.randint(0, 6000) for _ in range(8)))
        cuts = sorted({rng.randint(1, 6000) for _ in range(5)})
        edges = [(a, b) for a, b in zip([0, *cuts], [*cuts, 10_000])]
        for s, r in zip(spans, secrets._scopes(spans, cuts)):
            assert list(r) == [n for n, (a, b) in enumerate(edges) if s[0] < b and s[1] > a]


def test_redaction_leaves_nothing_and_clean_texts_alone(make_docs):
    text = f"a user=admin {OPAQUE} b {KEY} c token = 'abcdefgh' d"
    assert not re.search(f"{OPAQUE}|AKIA|abcdefgh|admin", secrets.redact(text)) and secrets.redact("clean") == "clean"
    docs = make_docs([(1, text), (2, "clean"), *ODD])
    got = secrets.redact_documents(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() == docs.count()
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_query_columns_against_brute_force(spark, make_docs):
    def check(rows, texts):
        for r in rows:
            want = brute(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k in want) for x in ("assign", "access", "hex"))
            assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(r.spans.split(","))

    docs = dict(enumerate(TEXTS))
    check(secrets.scan(make_docs(list(docs.items()))).collect(), docs)
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(catalog.op10_secret_scan(spark, sf).collect(), texts)
    assert secrets.scan(make_docs([])).collect() == []
