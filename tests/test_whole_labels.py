"""Labels of whole texts: what is at a long text's end is cleaned like its start."""

import pytest

from millrace.plans import QUERIES

LONG = "Ein Satz über Wörter. " * 40
#: doc_id: text, normalised label, final label; all by hand.
CASES = {
    1: (LONG + "(Prüfung) end", LONG + "end", LONG.lower().replace(".", "") + "end"),
    2: (LONG + "Contributed by Lea Korn. [x] fix-up/`it`; b é c", LONG + "fix up it é", LONG.lower().replace(".", "") + "fix up it é"),
    3: ("one (Reviewed by Tom) two", "one two", "one two"),
    4: ("a tale of b cities", "tale of cities", "tale of cities"),
    5: ("left-hand/right-hand `code`, [x]; done", "left hand right hand code done", "left hand right hand code done"),
    6: (LONG + "\n\n" + LONG + "fixes xyz", LONG + LONG + "fixes xyz", LONG.lower().replace(".", "") * 2 + "fix xyz"),
    7: ("", "", ""),
    8: (None, None, None),
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, t, [None, "de"][i % 2]) for i, (t, _, _) in CASES.items()], "doc_id long, text string, lang string").write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.mark.parametrize("name, place", [("normalize_labels", 1), ("semantic_labels", 2)])
def test_labels_of_whole_texts(spark, sf_dir, name, place):
    assert {r.doc_id: r.label for r in QUERIES[name](spark, sf_dir).collect()} == {i: case[place] for i, case in CASES.items()}
