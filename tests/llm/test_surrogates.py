import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import surrogates as S
from docloom.sources import written


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS e", "7 AS kind", "0 AS n_entities")
    return {r.doc_id: (r.n_entities, r.text) for r in S.replace_entities(df).collect()}


def test_formats_and_coreference(spark):
    t = "Write to anna.b@mail.org or call +49 170 1234567. Mrs Anna Keller, IP 10.1.2.3, card 4111 1111 1111 1111, SSN 123-45-6789."
    got = run(spark, [(1, t), (2, "Mrs Anna Keller met Mr Paul Keller; anna.b@mail.org"), (3, "г-жа Анна Петрова")])
    n, out = got[1]
    assert n == 6 and not re.search(r"anna\.b|1234567|Keller|10\.1\.2\.3|4111 1111|123-45-6789", out)
    email = re.search(r"\S+@\S+\.org", out)[0]
    assert email in got[2][1] and re.search(r"\+49 \d{3} \d{7}", out) and re.search(r"SSN \d{3}-\d{2}-\d{4}\.", out)
    name = re.search(r"Mrs (\S+) (\S+),", out)
    assert name and name[1].endswith("na") and got[2][1].startswith(f"Mrs {name[1]} {name[2]} met Mr ")
    card = re.search(r"card ([\d ]+),", out)[1].replace(" ", "")
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    assert re.fullmatch(r"г-жа [А-Я][а-я]+на [А-Я][а-я]+нова", got[3][1])


def test_distinct(spark):
    emails = [f"u{i}@d.org" for i in range(800)]
    got = run(spark, [(i, f"mail {e} now") for i, e in enumerate(emails)])
    new = [t.split()[1] for _, t in got.values()]
    assert len(set(new)) == len(emails) and not set(new) & set(emails)


def test_clean_and_edges(spark):
    plain = "A plain text of the year 1999 with 12 apples. The End."
    got = run(spark, [(1, plain), (2, None), (3, ""), (4, "a " * 50_000 + "x@y.org"), (None, plain)])
    assert got[1] == (0, plain) and got[2] == (0, None) and got[3] == (0, "") and got[None] == (0, plain)
    assert got[4][0] == 1 and got[4][1].startswith("a " * 50_000) and "x@y.org" not in got[4][1]
    assert run(spark, [(1, "x@y.org"), (1, "x@y.org")])[1][0] == 1
    assert S.replace_entities(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours_of_every_pair_of_kinds(spark):
    """Each of two entities side by side is found whole, and none takes a part of the other."""
    kinds = {
        "email": ["anna.b@mail.org"], "secret": ["password=abcdefgh12"], "ip": ["190.137.223.204", "97.51.17.173"], "ssn": ["123-45-6789"], "card": ["9807915762804490", "4111 1111 1111 1111"],
        "phone": ["+1 (826) 555-4081", "+49 170 1234567"], "iban": ["ES9121000418450200051332", "DE89370400440532013000"], "name": ["Mrs Anna Keller"],
    }
    every = [x for xs in kinds.values() for x in xs]
    rows = [(a, b) for a in every for b in every]
    df = spark.createDataFrame([(f"See {a} {b} now", a, b) for a, b in rows], "text string, a string, b string")
    wrong = [(r.a, r.b, r.e) for r in df.select("a", "b", S.entities(df["text"]).alias("e")).collect() if r.e != [r.a, r.b]]
    assert not wrong
    kind = {r.e: r.k for r in spark.createDataFrame([(x,) for x in every], "e string").select("e", S.kind_of(F.col("e")).alias("k")).collect()}
    assert kind == {x: k for k, xs in kinds.items() for x in xs}


def test_numbers_before_a_fraction_are_still_found(spark):
    df = spark.createDataFrame([("card 4111111111111111.5",), ("call +49 170 1234567.5",), ("call 826-555-4081-1 now",)], "text string")
    assert all(len(r.e) == 1 for r in df.select(S.entities(df["text"]).alias("e")).collect())


def test_surname_alone_is_the_same_person(spark):
    got = run(spark, [(1, "Mrs Anna Keller came. Later Keller left; Kellerman stayed."), (2, "Keller alone"), (3, "г-жа Анна Петрова и Петрова")])
    n, text = got[1]
    new = re.search(r"Mrs \w+ (\w+) came\. Later (\w+) left; Kellerman stayed", text)
    assert n == 2 and new[1] == new[2] != "Keller" and got[2] == (0, "Keller alone")
    russian = got[3][1].split()
    assert got[3][0] == 2 and russian[2] == russian[4] != "Петрова"


def test_common_words_are_no_names(spark):
    text = "Dr Will May came in May 2020 with Frau Koch. In May it rained; the Koch family left, der Koch blieb. Mr Anton Bauch und sein bauch: Bauch."
    n, out = run(spark, [(1, text)])[1]
    assert "came in May 2020" in out and "In May it rained" in out and "der Koch blieb" in out and "the Koch family" in out and out.endswith("sein bauch: Bauch.")
    assert n == 3 and "Will May" not in out and "Frau Koch" not in out and "Anton" not in out


def test_names_without_titles(spark):
    n, out = run(spark, [(1, "Kurt Meyer, Aylin Demir and Jonas Wolf met; Wolf spoke.")])[1]
    assert n == 4 and not re.search("Meyer|Demir|Wolf|Kurt|Aylin|Jonas", out)


def test_no_key_no_run(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="surrogateKey"):
        S.secret_key(Cluster())
    assert S.secret_key(spark) == S.DEMO_KEY


def test_text_with_the_mark(spark):
    got = run(spark, [(1, "odd ￿ text a@b.org end￿ 10.1.2.3"), (2, "￿")])
    assert got[1][0] == 2 and got[1][1].startswith("odd ￿ text ") and "a@b.org" not in got[1][1] and " end￿ " in got[1][1]
    assert got[2] == (0, "￿")


def test_key_of_the_session(spark):
    before = run(spark, [(1, "a.b@mail.org")])
    spark.conf.set(S.KEY_SETTING, "another")
    try:
        assert run(spark, [(1, "a.b@mail.org")]) != before
    finally:
        spark.conf.unset(S.KEY_SETTING)
    assert run(spark, [(1, "a.b@mail.org")]) == before


def test_iban_keeps_right_check_digits(spark):
    def right(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    given = ["ES9121000418450200051332", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013001"]
    got = run(spark, [(i, f"pay {x}, please") for i, x in enumerate(given)])
    new = [re.search(r"pay (.*), please", got[i][1])[1] for i in range(3)]
    assert [right(x) for x in new[:2]] == [right(x) for x in given[:2]] == [True, True]
    assert all(a != b and len(a) == len(b) and a[:2] == b[:2] for a, b in zip(given, new))


def test_against_a_plain_search(spark, sf):
    """On all documents: Python's own search and one replacement for each entity give the same texts."""
    import regex

    java = regex.compile(S.PATTERN.replace("\\p{IsCyrillic}", "\\p{Cyrillic}"), regex.V0)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = {r.doc_id: r for r in S.replace_entities(docs).collect()}
    seen: dict[str, str] = {}
    for r in docs.collect():
        if r.text is None or java.search(r.text) is None:
            assert out[r.doc_id].text == r.text and out[r.doc_id].n_entities == 0
            continue
        spans = [m.span() for m in java.finditer(r.text)]
        between, at = [], 0
        for a, b in spans:
            between.append(r.text[at:a])
            at = b
        between.append(r.text[at:])
        whole = regex.fullmatch("(.*?)".join(map(regex.escape, between)), out[r.doc_id].text, regex.S)
        assert whole and out[r.doc_id].n_entities == len(spans)
        for (a, b), new in zip(spans, whole.groups()):
            assert seen.setdefault(r.text[a:b], new) == new and new != r.text[a:b]
    assert len(set(seen.values())) == len(seen) > 0


def test_values_that_have_no_other_of_their_form(spark):
    """Signs alone, and numbers that are all taken, get longer surrogates in the end."""
    n, out = run(spark, [(1, "password: ------------ and more")])[1]
    assert n == 1 and re.fullmatch(r"password: -{12}[a-p]{4} and more", out)
    found = spark.createDataFrame([("phone", f"+123{d}") for d in range(10)], "kind string, value string")
    late = S.retries(found, "k")
    assert late.count() == 10
    made = {r.m for r in late.select(S.surrogate(F.col("kind"), F.col("value"), F.col("attempt"), "k").alias("m")).collect()}
    assert len(made) == 10 and all(re.fullmatch(r"\+123\d\d", m) for m in made)


def test_a_domain_of_very_many_labels(spark):
    mail = "a@" + "b." * 20_000 + "org"
    n, out = run(spark, [(1, f"mail {mail} now")])[1]
    assert n == 1 and out.startswith("mail ") and out.endswith(".org now") and len(out) == len(mail) + 9 and mail not in out


def test_queries_on_a_cluster_without_a_key(spark, sf, tmp_path, monkeypatch):
    """They take a key that is drawn for the application, and it is the same in all of them."""
    want = S.op5_surrogates(spark, sf).where("n_entities > 0").count()
    monkeypatch.setattr(written, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    got = [{r.doc_id: r.text for r in S.op5_surrogates(spark, sf).where("n_entities > 0").collect()} for _ in range(2)]
    assert S.key_of_run(spark) not in ("", S.DEMO_KEY) and got[0] == got[1] and len(got[0]) == want > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id: r.text for r in corpus_pipeline.private_data(spark, docs, sf).collect() if r.doc_id in got[0]} == got[0]
