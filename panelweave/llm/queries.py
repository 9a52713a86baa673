"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import shared_folder, table
from .jaccard_join import join_components
from .language_id import identify
from .media_sequences import document_media
from .merkle_manifest import manifest_report
from .piece_encoding import piece_digests
from .pivot_topk import integers, top_k
from .secret_ledger import secret_report
from .slot_sharding import shard_rows
from .source_mix import mix
from .spelling_variants import variants
from .toxicity import classify as toxic
from .warc import archived
from .weak_quality import classify

SHARDS = 40


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def kept_folder(spark: SparkSession, name: str, sf_dir: str) -> str:
    """What later runs on the same data folder find again."""
    return f"{shared_folder(spark)}/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def op1_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), model_file())


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"), kept_folder(spark, "secret-ledger", sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


def op9_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), SHARDS, maps=kept_folder(spark, f"slot-map-{SHARDS}", sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest_report(table(spark, sf_dir, "documents"), F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_piece_encoding, op2_media_sequences, op3_jaccard_join, op4_secret_ledger, op5_language_id, op6_source_mix, op7_warc_dictionary, op8_weak_quality, op9_slot_sharding, op10_pivot_topk, op11_merkle_manifest, op12_spelling_variants, op13_toxicity)}

_BLANK = r"\x20\x09-\x0D"
_KEYS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_PATTERNS = {"assign": rf"({_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}


def _span_sql(rank: int, kind: str) -> str:
    """Matches and the pieces between them alternate, so positions are running lengths."""
    pattern, group = _PATTERNS[kind], 2 if kind == "assign" else 0
    return f"""select blob_id, {rank} r, '{kind}' kind, unnest(list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))) pos, unnest(list_transform(hits, lambda x: length(x))) size, unnest(held) held
        from (select blob_id, regexp_extract_all(body, '{pattern}') hits, regexp_extract_all(body, '{pattern}', {group}) held, string_split_regex(body, '{pattern}') gaps from blobs)"""


def _base32_sql(digest: str) -> str:
    five = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> {shift}) & 31 as int) + 1, 1)"
    return f"array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr({digest}, 5 * i + 1, 5))::bigint), lambda v: {' || '.join(map(five, (15, 10, 5, 0)))}), '')"


def _crc32_sql(numbers: str) -> str:
    """Unsigned CRC-32 of a list of byte values, bit by bit."""
    bits = f"list_prepend(4294967295::bigint, flatten(list_transform({numbers}, lambda b: [b::bigint, 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({bits}, lambda a, x: case when xor(a, x) & 1 = 1 then xor(xor(a, x) >> 1, 3988292384) else xor(a, x) >> 1 end), 4294967295)"


_DIGITS = _crc32_sql("list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c))")
_NAMED = "concat(coalesce(cast(doc_id as varchar), ''), ':', run)"
_BYTES = _crc32_sql(f"list_transform(range(octet_length(encode({_NAMED}))), lambda i: ('0x' || substr(hex(encode({_NAMED})), 2 * i + 1, 2))::int)")


def _field_sql(name: str) -> str:
    return f"case when {name} is null then '-' else octet_length(encode(cast({name} as varchar))) || ':' || {name} end"


def _leaf_sql(text: str = "text") -> str:
    return f"sha256(concat({', '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


def _tree_sql(name: str, leaves: str) -> str:
    return f"{name} as (select source, 0 lvl, pos idx, h, total from {leaves} union all select source, lvl + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (total + 2) // 3 from {name} where total > 1 group by source, lvl, idx // 3, total)"


def _steps_sql(leaves: str, tree: str) -> str:
    at = "(l.pos // cast(pow(3, lvl) as bigint))"
    return f"select l.source, l.pos, lvl, coalesce(string_agg(n.h, '' order by idx) filter (idx < {at}), '') a, coalesce(string_agg(n.h, '' order by idx) filter (idx > {at}), '') b from {leaves} l join {tree} n on n.source is not distinct from l.source and n.total > 1 and idx // 3 = {at} // 3 group by 1, 2, 3"


SQL: dict[str, str] = {
    "op3_jaccard_join": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_BLANK}]+') w from documents),
    s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) g from w where len(w) > 0),
    n as (select doc_id, count(*) n from s group by 1),
    c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
    reach as (select a, b from e union select reach.a, e.b from reach join e on e.a = reach.b), least as (select a, min(b) b from reach group by 1)
    select d.doc_id, coalesce(n, 0) n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) component_id from documents d left join n on n.doc_id = d.doc_id left join least on least.a = d.doc_id""",
    "op4_secret_ledger": f"""with v as (select doc_id, coalesce(text, '') body, sha256(coalesce(text, '')) blob_id from documents), blobs as (select distinct blob_id, body from v),
    found as ({' union all '.join(_span_sql(rank, kind) for rank, kind in enumerate(_PATTERNS))}),
    kept as (select blob_id, count(*) filter (r = 0) a, count(*) filter (r = 1) k, count(*) filter (r = 2) h, string_agg(kind || ':' || pos::bigint || ':' || (pos + size)::bigint, ',' order by pos, r) s from found where kind <> 'assign' or length(held) >= 6 group by 1)
    select doc_id, coalesce(a, 0) n_assign, coalesce(k, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(s, '')) base_sha256, coalesce(s, '') spans, blob_id from v left join kept using (blob_id)""",
    "op6_source_mix": f"""with r as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+')) size, md5('mix-1:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) draw from documents),
    s as (select source, sum(size)::bigint source_size from r group by 1), o as (select *, source_size * 2 clamp, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight from s),
    f as (select *, coalesce(sum(clamp) over (w rows between unbounded preceding and 1 preceding), 0) below, sum(weight) over (w rows between current row and unbounded following) above, sum(source_size) over () total from o window w as (order by clamp / weight, source nulls last)),
    l as (select *, (total * 1.5::double - below) / above level from f), m as (select min(struct_pack(below, level)) filter (level * weight <= clamp) m from l),
    t as (select source, source_size, case when m is null or m.level * weight > clamp then clamp::double else m.level * weight end target from l, m),
    q as (select r.*, source_size, target, coalesce(sum(size) over (partition by r.source order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) ahead, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end times from r join t on r.source is not distinct from t.source)
    select doc_id, size, source_size, target, cast(times * size + greatest(0, least(size, floor(target)::bigint - times * source_size - ahead)) as bigint) taken from q""",
    "op7_warc_dictionary": f"""with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages), o as (select h, max(page_id) original from p group by 1)
    select page_id, octet_length(encode(html)) payload_bytes, {_base32_sql('h')} payload_digest, case when page_id = original then 'response' else 'revisit' end record_type, case when page_id <> original then original end refers_to from p join o using (h)""",
    "op10_pivot_topk": """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) v from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id query_id, c.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) score from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 100 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from s)
    select query_id, cast(n as int) "rank", vec_id, score from r where n <= 10""",
    "op11_merkle_manifest": f"""with recursive d as (select *, {_leaf_sql()} h, case when {_DIGITS} % 2 = 0 then replace(text, chr(10), '') else text end other from documents),
    l as (select doc_id, source, h, {_leaf_sql("other")} start, row_number() over (partition by source order by doc_id nulls first, h) - 1 pos, count(*) over (partition by source) total from d),
    {_tree_sql("tree", "l")}, r as (select source, h subroot from tree where total = 1),
    o as (select source of_source, null source, subroot h, row_number() over (order by source nulls first) - 1 pos, count(*) over () total from r), {_tree_sql("top", "o")}, low as ({_steps_sql("l", "tree")}), high as ({_steps_sql("o", "top")}),
    s as (select source, pos, lvl k, a, b from low union all select l.source, l.pos, high.lvl + coalesce((select max(lvl) from tree t where t.source is not distinct from l.source), 0) k, a, b from l join o on of_source is not distinct from l.source join high on high.pos = o.pos),
    p as (select source, pos, sha256(string_agg(a || b, '' order by k)) proof, max(k) + 1 depth from s group by 1, 2),
    f as (select source, pos, 0 k, start h from l union all select f.source, f.pos, f.k + 1, sha256(s.a || f.h || s.b) from f join s on s.source is not distinct from f.source and s.pos = f.pos and s.k = f.k)
    select doc_id, l.h leaf, subroot, (select h from top where total = 1) root, coalesce(proof, sha256('')) proof_sha256, f.h folded_root, f.h = (select h from top where total = 1) verified
    from l join r on r.source is not distinct from l.source left join p on p.source is not distinct from l.source and p.pos = l.pos join f on f.source is not distinct from l.source and f.pos = l.pos and f.k = coalesce(depth, 0)""",
    "op12_spelling_variants": f"""with recursive runs as (select doc_id, run, count(*) c from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) run from documents) group by 1, 2),
    hashed as (select *, {_BYTES} h from runs),
    w as (select word, sum(c)::bigint n from (select case when h % 199 = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end word, c from hashed) group by 1 having sum(c) >= 5 and length(word) >= 6),
    cut as (select word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) rest, substr(word, i, 1) letter from (select *, unnest(range(1, length(word) + 1)) i from w)),
    apart as (select distinct cut.word a, w.word b from cut join w on w.word = rest),
    near as (select x.word, y.word near, y.n near_n from cut x join cut y on x.rest = y.rest and x.i = y.i and x.letter <> y.letter
        union all select a, b, n from apart join w on word = b union all select b, a, n from apart join w on word = a),
    best as (select *, count(*) over (partition by word) n_near, row_number() over (partition by word order by near_n desc, near) place from near),
    f as (select w.word, w.n, coalesce(n_near, 0) n_near, case when near_n >= 5 * w.n then near end form, case when near_n >= 5 * w.n then near_n end form_n from w left join best on best.word = w.word and place = 1),
    chain as (select word, word root from f union all select chain.word, f.form from chain join f on f.word = chain.root and f.form is not null)
    select f.word, f.form, root, f.n, f.n_near, f.form_n from f join chain on chain.word = f.word join f g on g.word = chain.root and g.form is null""",
}
