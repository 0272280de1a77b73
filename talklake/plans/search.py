"""Lexical, vector and fused search."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lexical import ANALYSERS, fuse, matching
from ..operators.topk import best_texts, nearest, nearest_to
from ..sources.archive import Archive, with_sql
from ..sources.tables import table
from .listing import part_of

#: Constant of reciprocal rank fusion, and BM25's two parameters (fixed values of the published formulas).
RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75
WORDS = ("mirror", "volume")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the words contain the phrase's words in a row. The words are made once, not once per place."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


#: Letters with diacritics and their bases, as far as the index's tokenizer folds them.
_MARKED = {c: d[0] for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])}


def plain_tokens(c: Column | str) -> Column:
    """Tokens without diacritics."""
    return tokens(folded(c))


def folded(c: Column | str) -> Column:
    """Lower-cased text without diacritics."""
    plain = F.translate(F.lower(F.col(c) if isinstance(c, str) else c), "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_replace(plain, r"[\x{300}-\x{36f}]", "")


def fold(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(x))


def candidate_limit(limit: int) -> int:
    """How many of the newest matches are looked at for `limit` results; fixed values."""
    return min(5000, max(200, 20 * limit))


_VARIANTS: dict[str, str] = {}
for _c, _b in _MARKED.items():
    _VARIANTS[_b] = _VARIANTS.get(_b, "") + _c


def spelled(word: str) -> str:
    """Pattern of a folded word in lower-cased text, with or without diacritics."""
    return "".join((f"[{c}{_VARIANTS[c]}]" if c in _VARIANTS else re.escape(c)) + r"[\x{300}-\x{36f}]*" for c in word)


def units(query: str) -> list[list[str]]:
    """The units of a query, which is split on white space only; a unit of several words is a phrase, quotes are no words."""
    return [w for u in query.split() if (w := re.findall(r"[^\W_]+", fold(u)))]


def search_units(df: DataFrame, query: str, fields: list[str], limit: int, include_empty: bool = False) -> DataFrame:
    """Rows that hold every unit of the query, newest id first.

    A unit, with its words in a row, may be in any of the fields. Candidates are capped before the empty ones are
    dropped, as in the archive's own search; an empty query has no results. Rows in which a pattern
    doesn't find all the words are dropped before any text is cut into words.
    """
    wanted = units(query)
    if not wanted:
        return df.limit(0)
    hit = df
    for w in {w for u in wanted for w in u}:
        hit = hit.where(reduce(Column.__or__, [F.coalesce(F.rlike(F.lower(f), F.lit(spelled(w))), F.lit(False)) for f in fields]))
    hit = hit.select("*", *[plain_tokens(f).alias(f"_{f}") for f in fields])
    for u in wanted:
        hit = hit.where(reduce(Column.__or__, [has_phrase(F.col(f"_{f}"), u) for f in fields]))
    newest = [F.desc(F.col("id").try_cast("long")), F.desc("id")]
    hit = hit.orderBy(*newest).limit(candidate_limit(limit)).drop(*[f"_{f}" for f in fields])
    hit = hit if include_empty else hit.where("trim(coalesce(normalized_content, '')) <> ''")
    return hit.orderBy(*newest).limit(limit)


def searchable(a: Archive, guilds: list[str] | None = None, channel: str | None = None, author: str | None = None) -> DataFrame:
    """Messages that aren't deleted, with channel_name and author_name, by guilds, a channel and an author.

    channel: an id or part of a name; author: an id or part of a name. Guilds and ids reach the scan.
    """
    m = a.messages.where("not deleted")
    m = m.where(F.col("guild_id").isin(guilds)) if guilds else m
    p = a.members.select("guild_id", F.col("user_id").alias("author_id"), F.coalesce("nick", "global_name", "username").alias("author_name"))
    m = m.join(a.channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name")), "channel_id", "left").join(p, ["guild_id", "author_id"], "left")
    if channel:
        m = m.where((F.col("channel_id") == channel) | part_of("channel_name", channel))
    return m.where((F.col("author_id") == author) | part_of("author_name", author)) if author else m


FIELDS = ["author_name", "channel_name", "normalized_content"]
_shown = lambda: F.when(F.trim(F.coalesce("content", F.lit(""))) != "", F.col("content")).otherwise(F.col("normalized_content")).alias("content")


def lexical_search(spark: SparkSession, sf: str, query: str = "feature flag", limit: int = 50, guilds: list[str] | None = None, channel: str | None = None, author: str | None = None) -> DataFrame:
    """Visible messages that hold all words, each in the author's name, the channel's name or the normalized content."""
    return search_units(searchable(Archive(spark, sf), guilds, channel, author), query, FIELDS, limit).select("id", "channel_id", _shown())


def lexical_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same for one word in channels and by authors of some names."""
    return lexical_search(spark, sf, "flag", 100, channel="log", author="en")


def lexical_explained(spark: SparkSession, sf: str, query: str = 'stack "feature flag" zzqx') -> DataFrame:
    """Why a query finds nothing: how many visible messages hold each of its units alone."""
    m = searchable(Archive(spark, sf))
    out = None
    for u in units(query):
        hit = reduce(Column.__or__, [has_phrase(plain_tokens(f), u) for f in FIELDS])
        row = m.agg(F.lit(" ".join(u)).alias("unit"), F.count_if(hit).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def search_languages(df: DataFrame, query: str, fields: list[str], text: str, limit: int, languages: tuple[str, ...] = tuple(ANALYSERS)) -> DataFrame:
    """search_units and the analysers of the languages, each the newest candidates, fused."""
    newest = [F.desc(F.col("id").try_cast("long")), F.desc("id")]
    keep = [c for c in df.columns if c in ("id", "channel_id", "content", "normalized_content")]
    rankings = [search_units(df, query, fields, candidate_limit(limit)).select(*keep)]
    for language in languages:
        hit = matching(df, text, query, language)
        if hit is not None:
            rankings.append(hit.orderBy(*newest).limit(candidate_limit(limit)).select(*keep))
    return fuse(rankings, "id", newest, limit)


#: Texts of languages that write without blanks or with affixes, each with a word that must find it; fixed values.
LANGUAGE_CASES = (
    ("ko-1", "오늘저녁먹음", "저녁"), ("ko-2", "서울맛집추천", "맛집"), ("ko-3", "프로젝트검색기능", "검색"), ("ko-4", "회의기록정리", "기록"), ("ko-5", "운동계획세움", "계획"),
    ("ja-1", "東京都庁に行きます", "東京"), ("ja-2", "自然言語処理を学ぶ", "言語"), ("ja-3", "検索機能を改善する", "検索"), ("ja-4", "会議記録を整理する", "記録"), ("ja-5", "機械学習モデル", "学習"),
    ("zh-1", "自然语言处理很有趣", "语言"), ("zh-2", "北京大学校园很美", "大学"), ("zh-3", "搜索功能需要改进", "搜索"), ("zh-4", "会议记录已经完成", "记录"), ("zh-5", "机器学习模型上线", "学习"),
    ("ar-1", "والكتاب مفيد للطلاب", "كتاب"), ("ar-2", "والمدرسة تفتح صباحا", "مدرسة"), ("ar-3", "فالاجتماع مهم اليوم", "اجتماع"), ("ar-4", "بالسجل تفاصيل كاملة", "سجل"), ("ar-5", "كالبرنامج سريع جدا", "برنامج"),
)


def language_cases(spark: SparkSession) -> DataFrame:
    """(case, found): whether the text of each case is among the five best for its word over all of them."""
    df = spark.createDataFrame([(i, t) for i, t, _ in LANGUAGE_CASES], "id string, normalized_content string")
    out = None
    for case, _, query in LANGUAGE_CASES:
        hit = search_languages(df, query, ["normalized_content"], "normalized_content", 5).select("id").where(F.col("id") == case)
        row = hit.agg(F.lit(case).alias("case"), F.count(F.lit(1)).alias("found"))
        out = row if out is None else out.unionByName(row)
    return out


def language_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a Japanese word, the greatest ids of them, through all analysers."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("normalized_content"))
    return search_languages(d, "検索", ["normalized_content"], "normalized_content", 50).select("id")


def _equals(word: str):
    return lambda x: x == word


def _bm25(df: DataFrame, key: str, text: str, words: tuple[str, ...]) -> DataFrame:
    """(key, score) of rows with any of the words; statistics are of the whole table."""
    w = df.select(key, tokens(text).alias("w")).withColumn("n", F.size("w"))
    for i, t in enumerate(words):
        w = w.withColumn(f"tf{i}", F.size(F.filter("w", _equals(t))))
    w = w.drop("w")
    s = w.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(F.lit(1.0) + (F.lit(s["docs"]) - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + F.lit(0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("n") / (s["avg"] or 1.0)))
    return w.withColumn("score", score).where("score > 0").select(key, "score")


def bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    r = _bm25(table(spark, sf, "documents"), "doc_id", "text", WORDS)
    return r.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@dataclass(frozen=True)
class Identity:
    """What vectors are of: only those of one provider, model, version of the input and number of dimensions are compared."""

    provider: str
    model: str
    input_version: str
    dimensions: int


def semantic(vectors: DataFrame, query: list[float], identity: Identity, limit: int = 20) -> DataFrame:
    """(id, score): the vectors of an identity with the greatest cosine to the query; equal scores go by the greater id.

    vectors: id, provider, model, input_version, dimensions, vector. An empty query, one of other dimensions or a zero
    vector is an error, and so is a stored vector that isn't as long as its row says. Stored zero vectors have no score.
    """
    if not query:
        raise ValueError("the query's vector is empty")
    if len(query) != identity.dimensions:
        raise ValueError(f"the query's vector has {len(query)} dimensions, not {identity.dimensions}")
    if not any(query):
        raise ValueError("the query's vector is zero")
    own = vectors.where((F.col("provider") == identity.provider.strip().lower()) & (F.col("model") == identity.model.strip()) & (F.col("input_version") == identity.input_version) & (F.col("dimensions") == identity.dimensions))
    whole = F.when(F.size("vector") == F.col("dimensions"), F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("corrupt vector of "), F.col("id").cast("string"))))
    return nearest_to(own.select("id", whole.alias("vector")), query, limit)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.lit("local").alias("provider"), F.lit("test").alias("model"), F.lit("v1").alias("input_version"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"))


def _semantic(spark: SparkSession, sf: str, limit: int, among: DataFrame | None = None) -> DataFrame:
    """The best vectors for that of id 0, among all or among those of some ids."""
    v = _vectors(spark, sf)
    q = v.where("id = 0").select("vector").first()
    if not q:
        return spark.createDataFrame([], "id long, score double")
    v = v if among is None else v.join(among, "id", "left_semi")
    return semantic(v, list(q[0]), Identity("local", "test", "v1", len(q[0])), limit)


def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    return _semantic(spark, sf, 20).select(F.col("id").alias("vec_id"), "score")


def semantic_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same among the documents of one kind that have a text."""
    d = table(spark, sf, "documents").where("doc_kind = 'guide' and trim(coalesce(text, '')) <> ''").select(F.col("doc_id").alias("id"))
    return _semantic(spark, sf, 20, d).select(F.col("id").alias("vec_id"), "score")


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of at most 200 fused by the sum of 1 / (60 + rank); ties prefer the lexical hit, then the greater id."""
    lex = _bm25(table(spark, sf, "documents"), "doc_id", "text", WORDS).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(200)
    sem = _semantic(spark, sf, 200)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("id")))  # over 200 rows
    both = lex.select("id", rank.alias("r"), F.lit(1).alias("lexical")).unionByName(sem.select("id", rank.alias("r"), F.lit(0).alias("lexical")))
    fused = both.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("r"))), 6).alias("score"), F.max("lexical").alias("lexical"))
    return fused.orderBy(F.desc("score"), F.desc("lexical"), F.desc("id")).limit(20)


#: The searches below take every row whose id is divisible by this as a query.
EVERY = 100


def _nearest(spark: SparkSession, sf: str, most: int) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(e, e.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"), most)


def _best_texts(spark: SparkSession, sf: str, queries: DataFrame, most: int, rising: bool) -> DataFrame:
    """BM25 with the texts of the documents of these ids (query_id) as queries."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tokens("text").alias("words"))
    asked = d.withColumnRenamed("id", "query_id").join(queries.select("query_id"), "query_id", "left_semi")
    return best_texts(d, asked, most, rising, BM25_K1, BM25_B)


def bm25_documents_all(spark: SparkSession, sf: str) -> DataFrame:
    """Best 50 documents for the text of each document whose id is divisible by EVERY."""
    asked = table(spark, sf, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"))
    return _best_texts(spark, sf, asked, 50, True).select("query_id", F.col("id").alias("doc_id"), "score")


def semantic_search_all(spark: SparkSession, sf: str) -> DataFrame:
    """Best 20 vectors for each vector whose id is divisible by EVERY."""
    return _nearest(spark, sf, 20).select("query_id", F.col("id").alias("vec_id"), "score")


def hybrid_search_all(spark: SparkSession, sf: str) -> DataFrame:
    """hybrid_search for each vector whose id is divisible by EVERY, with the text of the document of that id; without one, by the vector alone."""
    asked = table(spark, sf, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"))
    lex = _best_texts(spark, sf, asked, 200, False).withColumn("lexical", F.lit(1))
    both = lex.unionByName(_nearest(spark, sf, 200).withColumn("lexical", F.lit(0)))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("place"))), 6).alias("score"), F.max("lexical").alias("lexical"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("lexical"), F.desc("id"))
    return fused.withColumn("_r", F.row_number().over(w)).where("_r <= 20").drop("_r")


QUERIES = {f.__name__: f for f in (lexical_search, lexical_filtered, lexical_explained, language_search, bm25_documents, semantic_search, semantic_filtered, hybrid_search, bm25_documents_all, semantic_search_all, hybrid_search_all)}

_D_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_D_BM25 = rf"""w as (select doc_id, {_D_TOKENS} as w from documents), x as (select doc_id, len(w) as n, len(list_filter(w, lambda t: t = '{WORDS[0]}')) as a, len(list_filter(w, lambda t: t = '{WORDS[1]}')) as b from w),
s as (select count(*) as docs, avg(n) as av, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from x),
bm as (select doc_id, round(ln(1 + (docs - da + 0.5::double) / (da + 0.5::double)) * a * 2.2::double / (a + 1.2::double * (0.25::double + 0.75::double * n / av)) + ln(1 + (docs - db + 0.5::double) / (db + 0.5::double)) * b * 2.2::double / (b + 1.2::double * (0.25::double + 0.75::double * n / av)), 6) as score from x, s where a + b > 0)"""
_D_SEM = "sem as (select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings)"
_D_BM25_ALL = rf"""w as (select doc_id, {_D_TOKENS} as w from documents), s as (select count(*) as docs, avg(len(w)) as av from w),
t as (select doc_id, any_value(len(w)) as n, word, count(*) as tf from (select doc_id, w, unnest(w) as word from w) group by doc_id, word),
f as (select word, count(*) as df from t group by word),
bm as (select q.doc_id as query_id, t.doc_id, round(sum(ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * t.tf * 2.2::double / (t.tf + 1.2::double * (0.25::double + 0.75::double * t.n / av))), 6) as score from t join f using (word) join t q using (word), s where q.doc_id % {EVERY} = 0 group by 1, 2)"""
_D_SEM_ALL = f"sem as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id % {EVERY} = 0)"
_D_UNIT = r"list_has_any([{0}], regexp_extract_all(lower(strip_accents(coalesce(p.nick, p.global_name, p.username, ''))), '[\p{{L}}\p{{N}}]+') || regexp_extract_all(lower(strip_accents(coalesce(c.name, ''))), '[\p{{L}}\p{{N}}]+') || regexp_extract_all(lower(strip_accents(coalesce(m.normalized_content, ''))), '[\p{{L}}\p{{N}}]+'))"
SQL = {
    "lexical_filtered": with_sql("mcp", f"select id, channel_id, case when trim(coalesce(content, '')) <> '' then content else normalized_content end as content from (select m.* from m join c on c.id = m.channel_id join p on p.guild_id = m.guild_id and p.user_id = m.author_id where not m.deleted and contains(lower(c.name), 'log') and contains(lower(coalesce(p.nick, p.global_name, p.username)), 'en') and {_D_UNIT.format(chr(39) + 'flag' + chr(39))} order by m.id::bigint desc limit 2000) where trim(coalesce(normalized_content, '')) <> '' order by id::bigint desc limit 100"),
    "lexical_explained": with_sql("mcp", "select unit, n from (" + " union all ".join(f"select '{u}' as unit, count(*) filter ({_D_UNIT.format(chr(39) + u + chr(39))}) as n from m left join c on c.id = m.channel_id left join p on p.guild_id = m.guild_id and p.user_id = m.author_id where not m.deleted" for u in ("stack", "feature", "flag", "zzqx")) + ")"),
    "language_search": r"""with d as (select doc_id::varchar as id, doc_id, text from documents), w as (select *, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') as w from d),
a as (select id, row_number() over (order by doc_id desc) as r from (select * from w where list_contains(w, '検索') order by doc_id desc limit 1000) where trim(text) <> '' order by r limit 1000),
b as (select id, row_number() over (order by doc_id desc) as r from (select * from d where contains(text, '検索') order by doc_id desc limit 1000)),
c as (select id, r from (select id, row_number() over (order by doc_id desc) as r from (select * from w where list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), '検索') order by doc_id desc limit 1000)))
select id from (select id, round(sum(1.0::double / (60 + r)), 9) as score from (select * from a union all select * from b union all select * from c) group by 1) order by score desc, id::bigint desc limit 50""",
    "semantic_filtered": "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings where vec_id in (select doc_id from documents where doc_kind = 'guide' and trim(coalesce(text, ''), ' ') <> '') order by score desc, vec_id desc limit 20",
    "lexical_search": with_sql("mcp", f"select id, channel_id, case when trim(coalesce(content, '')) <> '' then content else normalized_content end as content from (select m.* from m left join c on c.id = m.channel_id left join p on p.guild_id = m.guild_id and p.user_id = m.author_id where not m.deleted and {_D_UNIT.format(chr(39) + 'feature' + chr(39))} and {_D_UNIT.format(chr(39) + 'flag' + chr(39))} order by m.id::bigint desc limit 1000) where trim(coalesce(normalized_content, '')) <> '' order by id::bigint desc limit 50"),
    "bm25_documents_all": f"with {_D_BM25_ALL} select * from bm qualify row_number() over (partition by query_id order by score desc, doc_id) <= 50",
    "semantic_search_all": f"with {_D_SEM_ALL} select * from sem qualify row_number() over (partition by query_id order by score desc, vec_id desc) <= 20",
    "hybrid_search_all": f"with {_D_BM25_ALL}, {_D_SEM_ALL}, l as (select query_id, doc_id as id, row_number() over (partition by query_id order by score desc, doc_id desc) as r, 1 as lexical from bm where query_id in (select vec_id from embeddings) qualify r <= 200), v as (select query_id, vec_id as id, row_number() over (partition by query_id order by score desc, vec_id desc) as r, 0 as lexical from sem qualify r <= 200), u as (select query_id, id, round(sum(1.0::double / (60 + r)), 6) as score, max(lexical) as lexical from (select * from l union all select * from v) group by query_id, id) select * from u qualify row_number() over (partition by query_id order by score desc, lexical desc, id desc) <= 20",
    "bm25_documents": f"with {_D_BM25} select * from bm order by score desc, doc_id limit 50",
    "semantic_search": f"with {_D_SEM} select * from sem order by score desc, vec_id desc limit 20",
    "hybrid_search": f"with {_D_BM25}, {_D_SEM}, l as (select doc_id as id, row_number() over (order by score desc, doc_id desc) as r, 1 as lexical from bm qualify r <= 200), v as (select vec_id as id, row_number() over (order by score desc, vec_id desc) as r, 0 as lexical from sem qualify r <= 200) select id, round(sum(1.0::double / (60 + r)), 6) as score, max(lexical) as lexical from (select * from l union all select * from v) group by id order by score desc, lexical desc, id desc limit 20",
}
