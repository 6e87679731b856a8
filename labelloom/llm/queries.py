"""The queries of this subpackage on the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import (
    bytepairs, chat, jaccard, manifest, mixing, nearest, pages, pieces, quality, texts, tokens, urls, warc, whitening,
)


TOKEN_LIMIT = 2048


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_read(spark, folder, "documents"), _read(spark, folder, "labels"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "score",
    )


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.linked(_read(spark, folder, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    counted = tokens.with_tokens(docs, tokenizer("word_bpe_49k.json"))
    return counted.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(_read(spark, folder, "pages")).select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("original").alias("refers_to"),
    )


WARC_SQL = """
with p as (
    select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages
), g as (
    select d, max(page_id) as newest from p where n >= 1000 group by d
)
select page_id, n as payload_bytes, p.d as payload_digest,
    case when n >= 1000 and page_id is distinct from newest then 'revisit' else 'response' end as record_type,
    case when n >= 1000 and page_id is distinct from newest then newest end as refers_to
from p left join g on p.d = g.d and n >= 1000
"""


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages.with_text(_read(spark, folder, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Each assistant turn is a call that waits for the one before; the turn that follows is its result."""
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    name = F.when(F.col("turn") < 3, F.lit("answer")).otherwise(F.lit("follow_up"))
    call = lambda t: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), t)
    said = turns.filter("role = 'assistant'")
    size = F.char_length(F.coalesce("text", F.lit("")))
    calls = said.select(
        "conv_id", call(F.col("turn")).alias("call_id"), name.alias("name"),
        F.format_string('{ "turn": %d,  "n_chars": %d }', "turn", size).alias("arguments"),
        call(F.col("turn") - 2).alias("after"),
    )
    results = turns.filter("role = 'user'").select(
        call(F.col("turn") - 1).alias("call_id"), F.concat(F.lit("chars "), size).alias("content")
    )
    schemas = spark.sql(
        "select * from values ('answer', 'turn', 'integer', true, 0D, 2D), ('answer', 'n_chars', 'integer', true, 100D, null), "
        "('follow_up', 'turn', 'integer', true, 3D, null), ('follow_up', 'n_chars', 'integer', true, 1D, 1000D) "
        "as t(name, field, type, required, low, high)"
    )
    return chat.linked(calls, results, schemas)


CHAT_SQL = """
with recursive said as (
    select conv_id, turn, case when turn < 3 then 'answer' else 'follow_up' end as name,
        length(coalesce(text, '')) as n
    from conversations where role = 'assistant' and conv_id is not null and turn is not null
), every as (
    select conv_id, turn, min(name) as name, count(*) as n_calls,
        min('{ "turn": ' || turn || ',  "n_chars": ' || n || ' }') as args,
        min_by(n, '{ "turn": ' || turn || ',  "n_chars": ' || n || ' }') as n
    from said group by conv_id, turn
), answers as (
    select conv_id, turn - 1 as turn, min('chars ' || length(coalesce(text, ''))) as content, count(*) as n_results
    from conversations where role = 'user' group by all
), chain as (
    select conv_id, turn, 0::bigint as depth from every e
    where not exists (from every p where p.conv_id = e.conv_id and p.turn = e.turn - 2)
    union all
    select e.conv_id, e.turn, depth + 1 from chain c join every e on e.conv_id = c.conv_id and e.turn = c.turn + 2
), checked as (
    select *, concat_ws('; ',
        case when name = 'answer' and n < 100 or name = 'follow_up' and (n < 1 or n > 1000)
            then 'n_chars: out of range' end,
        case when name = 'answer' and turn < 0 then 'turn: out of range' end) as errors
    from every
)
select conv_id, 'c' || conv_id || '-' || turn as call_id, name, depth, coalesce(n_results, 0) as n_results, n_calls,
    errors = '' as valid, errors,
    '{"arguments":{"n_chars":' || n || ',"turn":' || turn || '},"id":"c' || conv_id || '-' || turn || '","name":"' || name
        || '"' || coalesce(',"result":"' || content || '"', '') || '}' as canonical
from checked left join answers using (conv_id, turn) left join chain using (conv_id, turn)
"""


def op6_chat_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn with its whole text: assistant turns are calls as in ``op6_chat_formatting``, user turns after one
    are its results, all other turns (system, opening prompts, other roles) are messages, roots of their own."""
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    name = F.when(F.col("turn") < 3, F.lit("answer")).otherwise(F.lit("follow_up"))
    key = lambda kind, t: F.concat(F.lit(kind), F.col("conv_id"), F.lit("-"), t)
    size = F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars")
    said = turns.filter("role = 'assistant'")
    calls = said.select(
        "conv_id", key("c", F.col("turn")).alias("call_id"), name.alias("name"),
        F.to_json(F.struct(size, "text", "turn")).alias("arguments"), key("c", F.col("turn") - 2).alias("after"),
    )
    answered = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("user").alias("role")).distinct()
    messages = turns.filter("not role <=> 'assistant'").join(answered, ["conv_id", "turn", "role"], "left_anti").select(
        "conv_id", key("m", F.col("turn")).alias("call_id"), F.lit("message").alias("name"),
        F.to_json(F.struct(size, "role", "text", "turn")).alias("arguments"), F.lit(None).cast("string").alias("after"),
    )
    results = turns.filter("role = 'user'").select(
        key("c", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    schemas = spark.sql(
        "select * from values ('answer', 'turn', 'integer', true, 0D, 2D), ('answer', 'n_chars', 'integer', true, 100D, null), "
        "('answer', 'text', 'string', true, null, null), ('follow_up', 'turn', 'integer', true, 3D, null), "
        "('follow_up', 'n_chars', 'integer', true, 1D, 1000D), ('follow_up', 'text', 'string', true, null, null), "
        "('message', 'turn', 'integer', true, 0D, null), ('message', 'n_chars', 'integer', true, null, null), "
        "('message', 'role', 'string', true, null, null), ('message', 'text', 'string', true, null, null) "
        "as t(name, field, type, required, low, high)"
    )
    return chat.linked(calls.unionByName(messages), results, schemas)


CHAT_TEXTS_SQL = """
with recursive turns as (
    select *, length(coalesce(text, '')) as n from conversations where conv_id is not null and turn is not null
), answered as (
    select distinct conv_id, turn + 1 as turn, 'user' as role from turns where role = 'assistant'
), said as (
    select conv_id, turn, role, n, text, 'c' || conv_id || '-' || turn as call_id,
        case when turn < 3 then 'answer' else 'follow_up' end as name
    from turns where role = 'assistant'
    union all
    select conv_id, turn, role, n, text, 'm' || conv_id || '-' || turn, 'message'
    from turns anti join answered using (conv_id, turn, role) where role is distinct from 'assistant'
), written as (
    select *, '{"n_chars":' || n || case when name = 'message' and role is not null then ',"role":' || to_json(role) else '' end
        || case when text is not null then ',"text":' || to_json(text) else '' end || ',"turn":' || turn || '}' as args
    from said
), every as (
    select conv_id, turn, call_id, name, count(*) as n_calls, min(args) as args, min_by(n, args) as n,
        min_by(role is null, args) as no_role, min_by(text is null, args) as no_text
    from written group by all
), answers as (
    select conv_id, turn - 1 as turn, min(text) as content, count(*) as n_results
    from turns where role = 'user' group by conv_id, turn
), chain as (
    select call_id, conv_id, turn, name, 0::bigint as depth from every e where name = 'message'
        or not exists (from every p where p.conv_id = e.conv_id and p.turn = e.turn - 2 and p.name <> 'message')
    union all
    select e.call_id, e.conv_id, e.turn, e.name, depth + 1
    from chain c join every e on e.conv_id = c.conv_id and e.turn = c.turn + 2 and c.name <> 'message' and e.name <> 'message'
), checked as (
    select *, concat_ws('; ',
        case when name = 'answer' and n < 100 or name = 'follow_up' and (n < 1 or n > 1000)
            then 'n_chars: out of range' end,
        case when name = 'message' and no_role then 'role: missing' end,
        case when no_text then 'text: missing' end,
        case when turn < 0 then 'turn: out of range' end) as errors
    from every
)
select k.conv_id, k.call_id, k.name, depth, coalesce(n_results, 0) as n_results, n_calls, errors = '' as valid, errors,
    '{"arguments":' || args || ',"id":"' || k.call_id || '","name":"' || k.name || '"'
        || case when content is not null then ',"result":' || to_json(content) else '' end || '}' as canonical
from checked k left join answers a on k.name <> 'message' and a.conv_id = k.conv_id and a.turn = k.turn
    left join chain c on c.call_id = k.call_id
"""


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts of the pages enter and leave lists on dates that follow from their first page; a page's
    number gives its fetch date."""
    start = F.to_date(F.lit("2024-01-01"))
    captures = _read(spark, folder, "pages").select(
        "page_id", "url", F.date_add(start, (F.col("page_id") % 360).cast("int")).alias("fetched")
    )
    hosts = captures.groupBy(urls.host(F.col("url")).alias("pattern")).agg(
        (F.min("page_id") % 180).cast("int").alias("day"), F.count(F.lit(1)).alias("n")
    ).filter("pattern <> ''")
    dated = lambda rows, pattern, action, later: rows.select(
        pattern.alias("pattern"), F.lit(action).alias("action"), F.date_add(start, F.col("day") + later).alias("since")
    )
    own = F.col("pattern")
    spam = hosts.filter(own.rlike("casino|bets|pills|ads-track"))
    entries = (
        dated(spam, own, "block", 0)
        .unionByName(dated(spam, own, "remove", 60))
        .unionByName(dated(spam, own, "block", 120))
        .unionByName(dated(hosts.filter("n % 3 = 0"), own, "allow", 30))
        .unionByName(dated(hosts.filter("n % 5 = 0"), F.concat(own, F.lit("/en/")), "block", 90))
    )
    out = urls.decided(captures, entries, "page_id", "url", "fetched")
    return out.select(F.col("id").alias("page_id"), "url", "host", "n_active", "pattern", "decision")


URL_SQL = """
with captures as (
    select distinct page_id, url, date '2024-01-01' + (page_id % 360)::int as fetched,
        lower(regexp_extract(url, '^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/:?#@]*[^/:?#@.])', 1)) as host
    from pages
), hosts as (
    select lower(regexp_extract(url, '^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/:?#@]*[^/:?#@.])', 1)) as pattern,
        date '2024-01-01' + (min(page_id) % 180)::int as day, count(*) as n
    from pages group by 1 having pattern <> ''
), spam as (
    select * from hosts where regexp_matches(pattern, 'casino|bets|pills|ads-track')
), entries as (
    select pattern, 'block' as action, day as since from spam
    union all select pattern, 'remove', day + 60 from spam
    union all select pattern, 'block', day + 120 from spam
    union all select pattern, 'allow', day + 30 from hosts where n % 3 = 0
    union all select pattern || '/en/', 'block', day + 90 from hosts where n % 5 = 0
), dated as (
    select pattern, since, max(action) as action from entries group by all
), spans as (
    select *, lead(since) over (partition by pattern order by since) as until from dated
), met as (
    select c.page_id, c.url, c.host, s.pattern, s.action
    from captures c left join spans s
        on s.action <> 'remove' and fetched >= since and (until is null or fetched < until)
        and (s.pattern = c.host or s.pattern = c.host || '/en/' and contains(lower(c.url), c.host || '/en/'))
)
select page_id, url, coalesce(host, '') as host, count(pattern) as n_active,
    arg_max(pattern, (length(pattern), action)) as pattern,
    coalesce(arg_max(action, (length(pattern), action)), 'none') as decision
from met group by page_id, url, host
"""


def op1_approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(_read(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)


def op2_mixing_weights(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixed(_read(spark, folder, "documents"), _read(spark, folder, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "p_clean", "p_low", "p_toxic", "rate", "copies")


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.sampled(_read(spark, folder, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    return found.select(
        F.col("key").alias("doc_id"), "sample", F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_digest"), "log_prob", "value", "log_inclusion",
    )


def op11_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.tiktoken")
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    both = bytepairs.decoded(bytepairs.encoded(docs, path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_read(spark, folder, "embeddings"), "vec_id", "embedding")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    fields = ("doc_id", "source", "lang", "n_chars")
    tampered = texts.lower_ascii(F.col("text"))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    leaves = docs.select(
        F.col("source").alias("group"), F.col("doc_id").alias("key"),
        manifest.leaf_of(*map(F.col, fields), F.col("text")).alias("leaf"),
        F.when(hit, manifest.leaf_of(*map(F.col, fields), tampered)).alias("changed"),
    )
    return manifest.manifest(leaves).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


MERKLE_SQL = """
with recursive crc_table as (
    select list(list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, b)
        order by b) as t
    from range(256) r(b)
), fields as (
    select doc_id, source, doc_id::varchar as d, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
        coalesce(strlen(text) || ':' || text, '-') as body,
        translate(coalesce(strlen(text) || ':' || text, '-'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low_body
    from documents
), hashed as (
    select doc_id, source, sha256(head || body) as leaf, sha256(head || low_body) as low_leaf,
        xor(4294967295, list_reduce(list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::bigint),
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint)) % 5 = 0 as hit
    from fields, crc_table
), leaves as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place,
        coalesce('=' || source, '') as tree
    from hashed
), nodes as (
    select 0 as level, tree, place, leaf as node from leaves
    union all
    select level + 1, tree, place // 16, sha256(string_agg(node, '' order by place))
    from (select *, count(*) over (partition by tree) as n from nodes) where n > 1
    group by level, tree, place // 16
), steps as (
    select a.tree, a.level, a.place, coalesce(string_agg(b.node, '' order by b.place) filter (b.place < a.place), '') as l,
        coalesce(string_agg(b.node, '' order by b.place) filter (b.place > a.place), '') as r
    from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.place // 16 = b.place // 16
    where a.level < (select max(m.level) from nodes m where m.tree = a.tree)
    group by a.tree, a.level, a.place
), subroots as (
    select tree, max_by(node, level) as subroot from nodes group by tree
), tops as (
    select 0 as level, row_number() over (order by tree) - 1 as place, tree, subroot as node from subroots
    union all
    select level + 1, place // 16, '', sha256(string_agg(node, '' order by place))
    from (select *, count(*) over () as n from tops) where n > 1 group by level, place // 16
), top_steps as (
    select a.level, a.place, coalesce(string_agg(b.node, '' order by b.place) filter (b.place < a.place), '') as l,
        coalesce(string_agg(b.node, '' order by b.place) filter (b.place > a.place), '') as r
    from tops a join tops b on a.level = b.level and a.place // 16 = b.place // 16
    where a.level < (select max(level) from tops)
    group by a.level, a.place
), inside as (
    select doc_id, leaf, tree, 0 as level, place, case when hit then low_leaf else leaf end as folded, '' as proof from leaves
    union all
    select doc_id, leaf, i.tree, i.level + 1, i.place // 16, sha256(l || folded || r), proof || l || r
    from inside i join steps s on s.tree = i.tree and s.level = i.level and s.place = i.place
), above as (
    select doc_id, leaf, i.tree, subroot, 0 as level, t.place, folded, proof
    from inside i join subroots s on s.tree = i.tree join tops t on t.level = 0 and t.tree = i.tree
    where i.level = (select max(m.level) from nodes m where m.tree = i.tree)
    union all
    select doc_id, leaf, tree, subroot, a.level + 1, a.place // 16, sha256(l || folded || r), proof || l || r
    from above a join top_steps s on s.level = a.level and s.place = a.place
)
select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, folded as folded_root, folded = node as verified
from above a join (select level as top, node from tops order by level desc limit 1) on a.level = top
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
    return found


def oracle_sql() -> dict[str, str]:
    return {
        "op6_chat_formatting": CHAT_SQL, "op6_chat_texts": CHAT_TEXTS_SQL, "op7_url_filters": URL_SQL, "op10_warc": WARC_SQL,
        "op13_merkle_manifest": MERKLE_SQL,
    }
