import pytest
from pyspark.sql import functions as F

from postwright.functions import scalars, text

LONG = "The claim was denied again and we need to know why."
CASES = [
    ("<p>Hello</p><p>World &amp; all</p>", "Hello\nWorld & all"),
    ("plain text stays", "plain text stays"),
    (f"{LONG}\nBest regards,\nAnn", LONG),
    ("Thanks\nshort mail", "Thanks\nshort mail"),
    (f"{LONG}\n> old\nmore", LONG),
    (f"{LONG}\nRegards\u00a0\nAnn", LONG),
    (f"{LONG}\n\u00a0> old\nmore", LONG),
    (f"{LONG}\nOn\u2003Mon, Ann wrote:\u00a0\nold", LONG),
    (f"{LONG}\n\u00a0From:\u00a0a@b.c\nSent: now\n\u00a0To: d@e.f\nSubject: x\nold", LONG),
    (f"\u00a0{LONG}\u3000\x1f", LONG),
    (f"{LONG}\nOn Mon, Ann wrote:\nold", LONG),
    (f"{LONG}\n-----Original Message-----\nold", LONG),
    (f"{LONG}\nFrom: a@b.c\nSent: now\nTo: d@e.f\nSubject: x\nold", LONG),
    (f"{LONG}\nFrom: the clinic\nwe wrote", f"{LONG}\nFrom: the clinic\nwe wrote"),
    ("short\n> quoted", "short\n> quoted"),
    (f"<div>{LONG}<blockquote>old</blockquote></div>", LONG),
    (f'<div>{LONG}<div class="gmail_quote">old</div></div>', LONG),
    (f"{LONG} This message contains CONFIDENTIAL information of ours", LONG),
    ("a  b\t\tc\n\n\n\nd ", "a b c\n\nd"),
    ("Écrivez à l'équipe, ñandú", "Écrivez à l'équipe, ñandú"),
    ("mail <a@b.c> now", "mail  now".replace("  ", " ")),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("chunk", [CASES])
def test_clean_text(spark, chunk):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(chunk)], "i int, raw string")
    got = {r.i: r.out for r in rows.select("i", text.clean_text("raw").alias("out")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(chunk)}


def test_embedding_text_and_ids(spark):
    df = spark.createDataFrame([(" Re: x ", "body"), ("  ", "body"), (None, "body")], "s string, b string")
    assert [r[0] for r in df.select(text.embedding_text("s", "b")).collect()] == ["Re: x\n\nbody", "body", "body"]
    import uuid

    ns = uuid.NAMESPACE_DNS
    got = spark.createDataFrame([("a",), ("tkt-1",)], "k string").select("k", scalars.stable_uuid(ns, "k").alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(ns, r.k)) for r in got)


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(scalars.cosine("a", "b"), 6)).collect()] == [1.0, None]


#: The examples of the published description of each step, and some words as a whole.
STEMS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop "
    "tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit "
    "conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope "
    "callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good "
    "revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend "
    "adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control "
    "roll roll generalizations gener oscillators oscil is is by by yyy yyi syllogy syllogi été été x1s x1s"
).split()


def test_published_stems(spark):
    from postwright.functions.porter import stemmed

    want = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = {r.word: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in want], "word string")).collect()}
    assert got == want


def test_lexemes_are_joined_back_in_order(spark, monkeypatch):
    rows = [(1, "The claims, CLAIMED and claiming: denials of 2 forms"), (2, ""), (3, None), (4, "denial denied the the"), (None, "lost")]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("lexemes", F.lit(1))
    want = {1: ["claim", "denial", "2", "form"], 2: [], 3: [], 4: ["denial", "deni"], None: []}
    for most in (500_000, 0):
        monkeypatch.setattr(text, "BROADCAST_STEMS", most)
        assert {r.id: r.lexemes for r in text.with_lexemes(df, "id", "body").collect()} == want


def test_addresses_lose_all_white_space_around(spark):
    df = spark.createDataFrame([("\t Ann@X.example\u00a0\n",), (None,)], "a string")
    assert [r[0] for r in df.select(text.normalize_email("a")).collect()] == ["ann@x.example", None]
