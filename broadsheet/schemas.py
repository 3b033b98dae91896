"""Table schemas, in the order the warehouse is filled."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


STRING, LONG, INT, DATE = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()

# Item produced from one page and carried as JSON on the topic.
ITEM = _struct(title=STRING, content=STRING, url=STRING, source=STRING, author=STRING, publish_date=STRING)

# Broker-shaped record; the file-backed topic uses the same columns.
TOPIC_RECORD = _struct(key=STRING, value=STRING, topic=STRING, partition=INT, offset=LONG, timestamp=T.TimestampType())

# Raw table: one row per URL, the whole item JSON kept in ``content``.
ARTICLE_METADATA = _struct(
    seq=LONG, url_hash=STRING, url=STRING, title=STRING, content=STRING, author=STRING, publish_date=STRING
)

WAREHOUSE = {
    "dim_source": _struct(source_id=LONG, domain=STRING),
    "dim_time": _struct(time_id=LONG, date=DATE, day=INT, month=INT, year=INT),
    "dim_content": _struct(content_id=LONG, url_hash=STRING, content=STRING),
    "dim_author": _struct(author_id=LONG, author_name=STRING),
    "fact_articles": _struct(
        article_id=LONG, url_hash=STRING, title=STRING, source_id=LONG, time_id=LONG, content_id=LONG, content_length=INT
    ),
    "fact_article_authors": _struct(article_id=LONG, author_id=LONG),
    "fact_chunks": _struct(chunk_id=LONG, article_id=LONG, chunk_index=INT, content=STRING),
}

# One row per finished load; also the list of runs whose files may be read.
RUN_LOG = _struct(found=LONG, processed=LONG, skipped=LONG, errors=LONG)

# Rows the gate or the date check turned away.
QUARANTINE = _struct(seq=LONG, url_hash=STRING, url=STRING, title=STRING, status=STRING, reason=STRING)

# Three letters in a row of a title, for searching titles.
TITLE_GRAMS = _struct(gram=STRING, article_id=LONG)

DENSE_DIM = 1024
DENSE_METRIC = "cosine"

VECTOR_POINT = T.StructType([
    T.StructField("id", STRING),
    T.StructField("dense", T.ArrayType(T.FloatType())),
    T.StructField("sparse", T.MapType(LONG, T.DoubleType())),
    T.StructField("payload", _struct(
        article_id=LONG, chunk_index=INT, title=STRING, url=STRING, content=STRING, authors=STRING, publish_timestamp=LONG
    )),
])
