"""The registered queries of the thirteen operators and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clusters, collocations, exact_dedup, html_text, near_dedup, neighbours, packing, pii, quality, repeats, token_store, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents")).drop("clean_text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_tokens(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end=2)
    return token_store.read_index(spark, store)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end=1, capacity=4096)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, best=2000)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(_table(spark, sf_dir, "documents"), width=13)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_byte_bpe, op3_html_extraction, op4_exact_dedup, op5_minhash_near_dedup, op6_token_output, op7_best_fit_packing, op8_quality_classifier, op9_nearest_neighbours, op10_warc, op11_phrase_collocations, op12_substring_dedup, op13_centroid_clustering)}


def _collocations_sql(least: int = 100, longest: int = 5, best: int = 2000) -> str:
    phrases = " union all ".join(f"select lang, list_slice(w, p, p + {k - 1}) as g from s where p + {k - 1} <= len(w)" for k in range(1, longest + 1))
    return rf"""
            with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
            q as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
            w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from q),
            s as (select lang, w, unnest(range(1, len(w) + 1)) as p from w),
            n as (select lang, count(*)::hugeint as n from s group by lang),
            f as materialized (select lang, g, count(*)::hugeint as f from ({phrases}) group by lang, g having count(*) >= {least}),
            b as (select lang, g, f as a from f where len(g) > 1),
            i as (select lang, g as whole, a, unnest(flatten(list_transform(range(1, len(g)), lambda x: list_transform(range(x + 1, len(g) + 1), lambda y: list_slice(g, x, y))))) as g from b where len(g) > 2),
            z as (select lang, g, max(a) as longer from i where len(g) < len(whole) group by lang, g),
            c as (select b.lang, b.g, a, unnest(range(1, len(b.g))) as k from b left join z using (lang, g) where longer is null or 100 * longer < 100 * a),
            x as (select c.lang, c.g, a, k, l.f as l, r.f as r, n, (1000 * a * n) // (l.f * r.f) as score
                from c join f l on l.lang = c.lang and l.g = list_slice(c.g, 1, k) join f r on r.lang = c.lang and r.g = list_slice(c.g, k + 1, len(c.g)) join n on n.lang = c.lang),
            y as (select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from x qualify row_number() over (partition by lang, g order by score, k) = 1),
            v as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from y)
            select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from v where rank <= {best}"""


def _repeats_sql(width: int = 13) -> str:
    window = " || ' ' || ".join(["word", *(f"lead(word, {k}) over o" for k in range(1, width))])
    return rf"""
            with d as (select row_number() over () as nr, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
            t as (select nr, doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
            k as (select nr, doc_id, p, {window} as seq from t window o as (partition by nr order by p)),
            f as (select seq, min(doc_id) as first_doc from k where seq is not null group by seq having count(*) > 1),
            c as (select distinct nr, unnest(range(p, p + {width})) as p from k join f using (seq) where doc_id > first_doc),
            l as (select nr, count(*) as n, list(word order by p) as kept from t anti join c using (nr, p) group by nr)
            select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(array_to_string(coalesce(kept, []), ' ')) as kept_sha256
            from d left join l using (nr)"""


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and exact means, one after the other."""
    near = """
            a{n} as materialized (select nr, min({{'d': d, 'c': c}}) as best from (
                select v.nr, c.c, sum((v.x - c.x) * (v.x - c.x)) as d from p v join c{n} c using (i) group by v.nr, c.c) group by nr)"""
    mean = """
            c{m} as materialized (select o.c, o.i, case when s.n is null then o.x else (s.t - ((s.t % s.n) + s.n) % s.n) // s.n end as x
                from c{n} o left join (select best.c as c, i, sum(x)::bigint as t, count(*) as n from a{n} join p using (nr) group by best.c, i) s using (c, i))"""
    steps = [near.format(n=n) + ("," + mean.format(n=n, m=n + 1) if n < rounds else "") for n in range(rounds + 1)]
    return f"""
            with e as (select row_number() over () as nr, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
                where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            p as materialized (select nr, unnest(q) as x, unnest(range(1, 65)) as i from e),
            f as (select nr, row_number() over (order by sha256('2:' || vec_id::varchar), q) - 1 as c from e where vec_id is not null qualify c < {k}),
            c0 as materialized (select c, i, x from f join p using (nr)),{",".join(steps)},
            h as (select c, sha256(string_agg(x::varchar, ',' order by i)) as sha from c{rounds} group by c)
            select vec_id, best.c::int as cluster, best.d::bigint as distance, sum(best.d) over (partition by best.c)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia, sha as centroid_sha256
            from e join a{rounds} using (nr) join h on h.c = best.c"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": r"""
            with n as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents),
            g as (select h, count(*) as group_size, arg_min(doc_id, {'c': -chars, 'i': doc_id}) as keep_id from n group by h)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from n join g using (h)""",
        "op9_nearest_neighbours": """
            with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
            n as (select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) as size from v),
            s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.size * c.size) as score from n q join n c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
            select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
        "op10_warc": """
            with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
            g as (select n, d, max(page_id) as last from p where n >= 1000 group by n, d)
            select page_id, n::bigint as payload_bytes, d as payload_digest, case when last is null or last = page_id then 'response' else 'revisit' end as record_type,
                   case when last <> page_id then last end as refers_to
            from p left join g using (n, d)""",
        "op11_phrase_collocations": _collocations_sql(),
        "op12_substring_dedup": _repeats_sql(),
        "op13_centroid_clustering": _clustering_sql(),
    }
