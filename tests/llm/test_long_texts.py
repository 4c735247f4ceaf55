"""Single texts of odd length that must neither crash nor stall an operator."""

import os

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from haulgrid.llm import licenses, pii
from haulgrid.llm.common import row_keyed
from haulgrid.llm.packing import Encoder, default_vocabulary, pack


@pytest.mark.parametrize("text", ["x" + " " * 1_000_000 + "y", "x" + "\n" * 1_000_000 + "y", "a \t" * 200_000, "b" * 1_000_000, "one" + "\t" * 20_000 + "<|endoftext|>" + " " * 9_999 + "two"])
def test_ids_of_long_runs_are_those_of_the_library(text):
    vocabulary = default_vocabulary()
    library = tokenizers.Tokenizer.from_file(os.path.splitext(vocabulary)[0] + ".json")
    got = np.frombuffer(Encoder(vocabulary).text(text), np.uint32)
    assert np.array_equal(got, np.array(library.encode(text, add_special_tokens=False).ids, np.uint32))


def test_long_blanks_are_packed(make):
    pieces = pack(make([(1, " " * 5_000_000), (2, "\n" * 5_000_000 + "end"), (3, "word")])).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == 3 and all(r.n == r.t for r in pieces)


def test_addresses_beyond_all_bounds(make):
    texts = [(1, "a@" + "b." * 100_000 + "org"), (2, "x" * 200_000 + "@site.org"), (3, "Mr A" + "a" * 200_000), (4, "write to joe.doe@mail.site.org."), (5, "1" * 500_000 + "." * 500_000)]
    rows = {r.doc_id: r for r in pii.pseudonymise(row_keyed(make(texts)), "key").collect()}
    assert [e.kind for e in rows[4].entities] == ["email"] and rows[4].text.endswith(".org.") and "joe" not in rows[4].text
    assert all(rows[k].entities == [] and rows[k].text == t for k, t in texts if k != 4)


def test_very_many_license_sentences(make):
    grant, condition, as_is = (licenses.SENTENCES[k] for k in ("mit_grant", "mit_condition", "as_is"))
    texts = [(1, "MIT License\n\n" * 100_000), (2, f"{grant}.\n\n" + "MIT License\n\n" * 20_000 + f"{condition}.\n{as_is}."), (3, f"{condition}.\n\n{grant}.\n\n{as_is}.")]
    rows = {r.doc_id: r for r in licenses.recognise(make(texts)).collect()}
    assert (rows[1].n_sentences, rows[1].licenses) == (100_000, "") and (rows[2].n_sentences, rows[2].licenses) == (20_003, "MIT") and rows[3].licenses == ""


def test_rules_are_sought_in_order(spark):
    rows = [(",a,b,c,", True), (",b,a,c,", False), (",a,a,b,", True), (",a,x,y,b,", True), (",ab,", False), (",,", False), (",b,", False), (",a,", False), (",b,a,b,", True)]
    got = spark.createDataFrame(rows, "ids string, want boolean").select("ids", "want", licenses.follows(F.col("ids"), ("a", "b")).alias("got")).collect()
    assert [(r.ids, r.got) for r in got] == rows
