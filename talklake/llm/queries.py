"""Queries of the operators for training text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_us, none_if_empty, reference
from ..operators.current import current_rows
from ..sources.tables import table
from .bpe import decode_texts, encode_texts, measure_texts
from .chunking import split_texts
from .neardup import document_pairs, grouped, near_duplicates
from .packing import pack
from .pii import items, redact
from .talks import ACCEPT, STATED, talks

#: Similarity and different words of p3, as TESTDATA.md states them.
SIMILAR, LEAST_WORDS = 0.7, 20
CAPACITY = 2048


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(table(spark, sf, "messages"), {"content": none_if_empty("content")})


def _pii(spark: SparkSession, sf: str, use) -> DataFrame:
    texts = current_rows(table(spark, sf, "messages"), {"content": none_if_empty("content"), "normalized_content": none_if_empty("normalized_content")})
    return use(texts, "id", ["content", "normalized_content"], table(spark, sf, "known_names"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pii(spark, sf, items).withColumnRenamed("id", "message_id")


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return _pii(spark, sf, redact).withColumnRenamed("id", "message_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    # texts that can't have twenty words aren't moved
    long = current_rows(table(spark, sf, "messages"), {"content": F.when(F.length("content") >= 2 * LEAST_WORDS - 1, F.col("content"))}).where("content is not null")
    x = document_pairs(*near_duplicates(long, "id", "content", SIMILAR, 1, LEAST_WORDS))
    first = (F.length("x") < F.length("y")) | ((F.length("x") == F.length("y")) & (F.col("x") < F.col("y")))
    return x.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("id_a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("id_b"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per message; messages without words are groups of their own."""
    return grouped(*near_duplicates(_contents(spark, sf), "id", "content", whole=True)).withColumnRenamed("key", "message_id")


def _turns(spark: SparkSession, sf: str, accept: float) -> DataFrame:
    columns = {
        "guild_id": F.trim("guild_id"),
        "channel_id": F.trim("channel_id"),
        "author_id": none_if_empty(F.trim("author_id")),
        "us": instant_us("created_at"),
        "reply_id": reference("reply_to_message_id"),
        "content": F.col("content"),
        "present": none_if_empty("deleted_at").isNull(),
    }
    return talks(current_rows(table(spark, sf, "messages"), columns), accept)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, STATED).select("start_id", F.col("turn").cast("int").alias("turn"), "message_id")


def _roles(spark: SparkSession, sf: str, accept: float) -> DataFrame:
    turns = _turns(spark, sf, accept)
    bots = table(spark, sf, "members").where("bot = 1").select(F.trim("user_id").alias("author_id")).distinct().withColumn("bot", F.lit(True))
    starter = turns.where("turn = 1").select("start_id", F.col("author_id").alias("starter"))
    t = turns.join(starter, "start_id").join(bots, "author_id", "left")
    role = F.when(F.col("author_id") == F.col("starter"), "starter").when(F.col("bot"), "bot").otherwise("member")
    return t.select("start_id", "turn", "message_id", "author_id", role.alias("role"))


def p6_talks(spark: SparkSession, sf: str) -> DataFrame:
    """Talks over stated and inferred links, each turn with its speaker's role."""
    return _roles(spark, sf, ACCEPT)


def p6_stated(spark: SparkSession, sf: str) -> DataFrame:
    """The same over stated links alone."""
    return _roles(spark, sf, STATED)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    from ..session import materialise

    return pack(materialise(measure_texts(table(spark, sf, "documents")), "lengths"), CAPACITY)


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(table(spark, sf, "documents"))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of each text decoded from its ids, which is the text's own."""
    return decode_texts(p8_ids(spark, sf)).select("doc_id", F.sha2("text", 256).alias("digest"))


def p9_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document: its pieces follow each other without a gap, and none is divided that fits; of all containers, how
    many are over their capacity, and whether they are as few as the tokens allow within a hundredth."""
    c = p9_containers(spark, sf)
    full = c.where("container > 0 or piece_tokens > 0").groupBy("container").agg(F.sum("piece_tokens").alias("n"))
    over = full.agg(F.count_if(F.col("n") > CAPACITY).alias("over"), (F.count(F.lit(1)) <= F.ceil(F.sum("n") / CAPACITY) * 1.01 + 1).alias("tight"))
    per = c.groupBy("doc_id").agg(F.max("piece").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("piece_tokens").alias("tokens"))
    per = per.select("doc_id", ((F.col("n") == F.col("last") + 1) & (F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / CAPACITY)))).alias("whole"), F.lit(1).alias("k"))
    return per.join(F.broadcast(over.withColumn("k", F.lit(1))), "k").drop("k")  # over is one row


def p10_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Of each text: how many code points its pieces cover from the first on, gaps between them, pieces over the limit."""
    w = Window.partitionBy("doc_id").orderBy("piece")
    p = p10_pieces(spark, sf).withColumn("before", F.lag("end_char").over(w))
    gap = F.when(F.col("before").isNull(), F.col("start_char") > 0).otherwise((F.col("start_char") > F.col("before")) | (F.col("end_char") <= F.col("before")))
    return p.groupBy("doc_id").agg(F.max("end_char").cast("long").alias("chars"), F.count_if(gap).alias("gaps"), F.count_if((F.col("n_tokens") > 512) | (F.length("text") != F.col("end_char") - F.col("start_char"))).alias("over"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p3_found, p3_groups, p6_found, p6_talks, p6_stated, p8_ids, p8_decoded, p9_containers, p9_filled, p10_pieces, p10_covered)}

_PRESENT = r"""
m as (select * from (select trim(id) as id, trim(channel_id) as channel_id, nullif(trim(author_id), '') as author_id, epoch_us(try_cast(created_at as timestamptz)) as us,
  nullif(nullif(regexp_replace(reply_to_message_id, '^\s+|\s+$', '', 'g'), ''), '0') as reply_id,
  nullif(deleted_at, '') is null and coalesce(nullif(trim(author_id), ''), '') <> '' and coalesce(regexp_replace(content, '[ \t\r\n]+', '', 'g'), '') <> '' as good,
  row_number() over (partition by trim(id) order by try_cast(updated_at as timestamptz) desc nulls last) as _rank
  from messages where trim(id) <> '') where _rank = 1)"""

_TALKS = f"""
with recursive {_PRESENT},
w as (
  select id, id as root, us, channel_id, author_id, good from m where reply_id is null
  union all
  select m.id, w.root, m.us, m.channel_id, m.author_id, m.good and m.us >= w.us from w join m on m.reply_id = w.id),
k as (select root from w group by root having count(*) > 1 and bool_and(good) and count(distinct channel_id) = 1 and count(distinct author_id) > 1),
t as (select root as start_id, row_number() over (partition by root order by us, id::hugeint)::int as turn, id as message_id, author_id from w join k using (root))
"""

_CONTENT = """c as (select * from (select trim(id) as id, nullif(content, '') as content, row_number() over (partition by trim(id) order by try_cast(updated_at as timestamptz) desc nulls last) as _rank from messages where trim(id) <> '') where _rank = 1),
w as (select id, regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+') as w from c)"""

SQL = {
    "p3_found": f"""
with {_CONTENT},
s as (select id, id::hugeint as k, list_distinct(w) as w, len(list_distinct(w)) as n from w where len(list_distinct(w)) >= {LEAST_WORDS})
select a.id as id_a, b.id as id_b from s a join s b on a.k < b.k and a.n * 10 >= b.n * 7 and b.n * 10 >= a.n * 7
where len(list_intersect(a.w, b.w)) * 10 >= (a.n + b.n - len(list_intersect(a.w, b.w))) * 7""",
    "p3_groups": f"""
with recursive {_CONTENT},
g as (select id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) end as g from w),
e as (select id, id::bigint as k, g, case when len(g) = 0 then id::bigint else min(id::bigint) over (partition by g) end as d from g),
classes as (select d, any_value(g) as g, count(*) as size from e group by d),
t as (select d, len(g) as n, unnest(g) as t from classes),
common as (select a.d as a, b.d as b, a.n as na, b.n as nb, count(*) as c from t a join t b on a.t = b.t and a.d <> b.d group by all),
pairs as materialized (select a, b from common where c * 10 >= (na + nb - c) * 8),
reach as (select d, d as root from classes union select p.a, r.root from reach r join pairs p on p.b = r.d where r.root < p.a),
roots as (select d, min(root) as group_id from reach group by d),
links as (select a as d, sum(size) as others from pairs join classes on classes.d = pairs.b group by 1)
select e.id as message_id, e.d as class_id, group_id, (size - 1 + coalesce(others, 0))::bigint as n_links from e join classes using (d) join roots using (d) left join links using (d)""",
    "p6_found": _TALKS + "select start_id, turn, message_id from t",
    "p6_stated": _TALKS + """, b as (select distinct trim(user_id) as author_id from members where bot = 1)
select t.start_id, t.turn, t.message_id, t.author_id, case when t.author_id = f.author_id then 'starter' when b.author_id is not null then 'bot' else 'member' end as role from t join t f on f.start_id = t.start_id and f.turn = 1 left join b on b.author_id = t.author_id""",
    "p8_decoded": "select doc_id, sha256(coalesce(text, '')) as digest from documents",
    "p9_filled": "select distinct doc_id, true as whole, 0::bigint as over, true as tight from documents",
    "p10_covered": "select doc_id, length(text)::bigint as chars, 0::bigint as gaps, 0::bigint as over from documents where text <> ''",
}
