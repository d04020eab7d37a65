import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import cleaning, dates, ids, quality


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_content_hash(spark):
    h = lambda t: one(spark, ids.content_hash(F.col("c")), c=t)
    assert h("  hello   world  ") == h("hello world") == h("Hello\n World") and h("a") != h("b") and h(None) is None


@pytest.mark.parametrize("kind, number, wanted", [("ICA", "ICA 96-1", "ica_96-1"), ("ICA", "ICA-96-1/2019", "ica_96-1/2019"), ("Portaria", " 12 ", "portaria_12"), ("Lei Complementar", "8666", "leicomplementar_8666"), ("", "1", None), ("lei", "--", None), (None, "1", None), ("ICA", "ICA96-1", "ica_96-1")])
def test_canonical_id(spark, kind, number, wanted):
    assert one(spark, ids.canonical_id(F.col("k"), F.col("n")), k=kind, n=number) == wanted


def test_ids(spark):
    assert one(spark, ids.document_id(F.lit("ICA"), F.lit("96-1"), F.lit("2019"), F.col("f")), f="x") == "ica_96-1/2019"
    assert one(spark, ids.document_id(F.lit(""), F.lit("96-1"), F.lit("2019"), F.col("f")), f="x") == "x"
    assert one(spark, ids.base_document(F.col("r")), r="ica_1-art5-2") == "ica_1" and one(spark, ids.base_document(F.col("r")), r="a/2020-chunk-3") == "a/2020"
    assert one(spark, ids.golden_id(F.col("r")), r="ICA-96-1-art563") == "ica_96-1-art563" and one(spark, ids.golden_id(F.col("r")), r="ica_7-58/2020-art2") == "ica_7-58-art2" and one(spark, ids.audit_id(F.col("r")), r="RBAC.E_94-art1/2020x") == "rbace_94-art1x"
    assert one(spark, ids.doc_type_name(F.col("r")), r=" decreto -  lei ") == "Decreto-Lei" and one(spark, ids.doc_type_name(F.col("r")), r="nsca") == "NSCA"
    assert one(spark, ids.chunk_id(F.col("r"), F.lit("t" * 300)), r="k") == one(spark, ids.chunk_id(F.col("r"), F.lit("t" * 101)), r="k")
    assert one(spark, ids.file_safe(F.col("r")), r="a/b ç") == "a_b__" and one(spark, ids.csv_set(F.col("r")), r=" a, b,,c ") == ["a", "b", "c"]
    assert one(spark, ids.first_filled(F.col("a"), F.col("b")), a="", b="z") == "z"


def test_cleaning_steps(spark):
    c = lambda t: spark.createDataFrame([(t,)], "content string").transform(cleaning.clean).first()
    assert c("ﬁm do texto Ｆ").clean == "fim do texto F"
    assert c("a\x03b\x00c﻿").clean == "a bc"
    assert c("x\n[Detalhes da Norma]\ny").clean == "x\n\ny"
    assert c("MINISTÉRIO DA DEFESA\ntexto").clean.startswith("MINISTÉRIO") and "MINISTÉRIO" not in c("MINISTÉRIO DA DEFESA\ntexto\nMinistério da Defesa\nfim").clean
    assert c("a\n10/26\nb 3/4 c\n9/2").clean == "a\nb 3/4 c\n9/2"
    assert c("CAPÍTULO I.........7\nfim").clean == "fim" and c("_____\nfim").clean == "fim"
    assert c("regu-\nlamento e controlador-piloto ADS-\nB").clean == "regulamento e controlador-piloto ADS-\nB"
    assert c("a  b\t\tc   \n\n\n\nd  ").clean == "a b c\n\nd"
    assert c("Art. 1º “x”").clean == 'Art. 1o "x"'
    assert c("DSURYD R UHJXODPHQWR GDV RSHUDFRHV\nHUNDRED metros de altura").clean == "HUNDRED metros de altura"
    assert c(None).clean is None and c("").clean == "" and c("").reduction_pct == 0.0 and c("a  b").chars_removed == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_nfkc(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cleaning.nfkc(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text, level", [("", "garbage"), (None, "garbage"), ("curto", "low"), ("a" * 199, "low"), ("a" * 200, "good"), ("1" * 300, "garbage"), ("a" * 60 + "1" * 200, "low"), ("a" * 120 + "1" * 100, "medium"), ("\x01" * 40 + "a" * 200, "garbage")])
def test_quality_levels(spark, text, level):
    df = spark.createDataFrame([(text,)], "content string")
    assert quality.quality_metrics(df).select(quality.quality_level().alias("l")).first()["l"] == level
    assert quality.accepted(df).count() == (level in ("medium", "good"))


def test_quality_counts(spark):
    r = quality.quality_metrics(spark.createDataFrame([("Ab 1²\n\n  \n12/34\n---\n" + "." * 21 + "\nMinistério  da Defesa",)], "content string")).first()
    assert (r.total_lines, r.empty_lines, r.digit_count, r.noise_lines, r.short_lines, r.toc_lines, r.header_repetitions, r.page_number_count, r.total_words) == (7, 2, 6, 3, 1, 1, 1, 1, 8)


@pytest.mark.parametrize("text, wanted", [("entra em vigor em 15/06/2023", "2023-06-15"), ("Entrará em vigor em 1º de dezembro de 2021.", "2021-12-01"), ("vigência a partir de 30 de AGOSTO de 2023", "2023-08-30"), ("na data de sua publicação", "1999-01-01"), ("entra em vigor em 45/13/2023", None), ("nada", None), (None, None)])
def test_effective_date(spark, text, wanted):
    assert one(spark, dates.effective_date(F.col("t"), F.lit("1999-01-01")), t=text) == wanted


@pytest.mark.parametrize("text, revoked, expiry", [("Fica revogada a Lei 1", False, None), ("foi revogada pela Portaria 2, de 01/02/2020", True, "2020-02-01"), ("a norma perde sua vigência em 3-4-21", True, "2021-04-03"), (None, False, None)])
def test_revocation(spark, text, revoked, expiry):
    assert one(spark, dates.is_revoked(F.col("t")), t=text) is revoked and one(spark, dates.expiry_date(F.col("t")), t=text) == expiry


def test_more_dates(spark):
    assert one(spark, dates.all_dates(F.col("t")), t="de 01/02/2020 a 31-12-99 ou 40/40/2020") == ["2020-02-01", "1999-12-31"]
    assert one(spark, dates.amended_act(F.col("t")), t="Altera a redação da Lei nº 1.234 de 2000") == "lei-1234"
