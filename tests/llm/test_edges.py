"""Every query on tables that are empty, hold only nulls, repeat their rows, or have extra columns with clashing names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlode.llm import queries

T0 = dt.datetime(2024, 1, 1)
TABLES = {
    "reviews": ("row_id bigint, batch_id int, app_dir string, reviewId string, userName string, content string, lang string, score int, at timestamp_ntz, replyContent string", [
        (1, 1, "a", "x", "Nadia Velmoor", "The compass works. My name is Nadia Velmoor.", "en", 5, T0, "Dear Nadia, thanks"),
        (1, 1, "a", "x", "Nadia Velmoor", "The compass works. My name is Nadia Velmoor.", "en", 5, T0, "Dear Nadia, thanks"),
        (2, 1, "a", None, "", "", "", None, None, ""),
        (3, 1, "a", "z", None, "itâ€™s brokÃ©n", None, 1, T0, None),
        (4, 2, "b", "y", " ", "long words here. " * 3000, "fr", 2, T0, "​ok"),
    ]),
    "rq1_tracker_negative_50": ("row_id bigint, reviewId string, app_name string, score int, at timestamp_ntz, content_clean string, theme_code string, theme string", [(1, "x", "a", 1, T0, "The compass works well for me", None, None), (2, None, None, None, None, None, None, None)]),
    "scrape_summary": ("row_id bigint, batch_id int, app_name string", [(1, 1, "Ð¡ÑƒÑ…ÑƒÑ€"), (2, 1, None), (3, 1, "")]),
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint, collected_at timestamp_ntz", [
        (1, "The cat sat on the mat. It was a good day for all of them.", "en", "a", 58, T0), (1, "The cat sat on the mat. It was a good day for all of them.", "en", "a", 58, T0),
        (2, None, None, None, 0, None), (3, "", "en", "a", 0, T0), (4, " \n ", None, "a", 3, T0), (5, "word " * 20_000, None, "a", 100_000, T0),
    ]),
    "eval_items": ("item_id bigint, suite string, text string", [(1, "s", " ".join(f"w{i}" for i in range(30))), (1, "s", " ".join(f"w{i}" for i in range(30))), (2, None, None), (None, "s", "some text here"), (3, "s", "")]),
    "graded_passages": ("passage_id bigint, lang string, reading_level int, text string", [(i, "en", 1 + i % 2, "The cat sat on the mat." if i % 2 else "Considerations of epistemology notwithstanding, deliberation continues.") for i in range(8)] + [(90, None, 1, "x y"), (91, "en", None, "The dog ran off."), (92, "en", 1, None)]),
}
CLASH = "text w n head rank seg_no field_name original normalised label label_ lang_ t f e kind words sent_no shared h w_ n_ g_ b spans doc".split()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for name, (schema, rows) in TABLES.items():
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{root}/plain/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
        df.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]).write.parquet(f"{root}/nulls/{name}.parquet")
        df.select("*", *[F.lit(1).alias(c) for c in CLASH if c not in df.columns]).write.parquet(f"{root}/clash/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_edges(spark, folders, name):
    run = queries.QUERIES[name]
    assert run(spark, f"{folders}/empty").count() == 0
    nulls = run(spark, f"{folders}/nulls").collect()
    assert not nulls or name in ("p8_ids", "p8_token_counts")  # null texts have ids too: none
    plain, clash = (sorted(map(str, run(spark, f"{folders}/{k}").collect())) for k in ("plain", "clash"))
    assert plain == clash
