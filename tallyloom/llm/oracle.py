"""SQL of the queries that are too long to stand beside them."""

from __future__ import annotations

#: Fixed values of the contract and the notices of the license scan, written out again.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _texts(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split(" ")) + "]"


def license_scan() -> str:
    """All places of all phrases, and all lines against all notices."""
    from tallyloom.llm.license_scan import NOTICES

    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{label}', {_texts(phrase)})" for phrase, label in PHRASES)
    notices = ", ".join(f"('{label}', list_distinct({_texts(words)}))" for label, words in NOTICES)
    return f"""
        with docs as materialized (select row_number() over () as r, doc_id, {LOWERED} as t from documents),
        words as (select r, doc_id, regexp_extract_all(t, '{pattern}') as w from docs),
        phrases(label, phrase) as (values {phrases}),
        starts as (select r, w, unnest(range(len(w))) as i from words),
        places as (select r, label, i from starts join phrases on w[i + 1] = phrase[1] and w[i + 1 : i + len(phrase)] = phrase),
        base as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list_distinct(list(label))) as labels from places group by r),
        notices(label, notice) as (values {notices}),
        lines as (select r, unnest(string_split(t, chr(10))) as line from docs),
        blocks as (select r, row_number() over () as block, list_distinct(regexp_extract_all(line, '{pattern}')) as b from lines),
        pairs as (select r, block, label, len(notice) as size, len(list_intersect(b, notice)) / len(notice)::double as held from blocks, notices where len(b) >= 3),
        best as (select r, label, held from pairs where held >= 0.9 qualify rank() over (partition by block order by held desc, size desc) = 1),
        more as (select r, max(held) as top, list(distinct label) as labels from best group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
               coalesce(array_to_string(base.labels, ','), '') as base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') as labels,
               case when n_base > 0 then 1.0 else coalesce(top, 0.0) end::double as score
        from words left join base using (r) left join more using (r)"""


def lexical_search() -> str:
    """Every item against every document that shares a term."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
        with words as materialized (select row_number() over () as r, doc_id, regexp_extract_all({LOWERED}, '{pattern}') as w from documents),
        docs as (select r, doc_id, len(w)::bigint as n from words where len(w) > 0),
        corpus as (select count(*)::bigint as all_docs, sum(n)::bigint as all_terms from docs),
        tf as (select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from words) group by all),
        weights as (select term, floor(1000 * ln((2 * all_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from tf, corpus group by term, all_docs),
        items as (select item_id, term, count(*)::bigint as repeats from (select item_id, unnest(regexp_extract_all({LOWERED}, '{pattern}')) as term from benchmark) group by all),
        scored as (
            select item_id, r, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::bigint as score
            from items join tf using (term) join weights using (term) join docs using (r), corpus
            group by item_id, r, doc_id)
        select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
        from scored where score > 0 qualify rank <= 20"""


def centroid_clustering() -> str:
    """Rounds written out one after the other, every vector against every centroid."""
    distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, c)])::bigint"
    nearest = lambda i: f"select vec_id, v, arg_min(k, (d, k)) as k, min(d) as d from (select vec_id, v, k, {distance} as d from vectors, centroids{i}) group by vec_id, v"
    rounds = ""
    for i in range(10):
        rounds += f"""
        near{i} as materialized ({nearest(i)}),
        sums{i} as (select k, j, sum(v[j])::hugeint as s, count(*)::hugeint as n from (select k, v, unnest(range(1, 65)) as j from near{i}) group by k, j),
        moved{i} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as c from sums{i} group by k),
        centroids{i + 1} as materialized (select k, coalesce(moved{i}.c, centroids{i}.c) as c from centroids{i} left join moved{i} using (k)),"""
    return f"""
        with vectors as materialized (
            select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = 64),
        centroids0 as materialized (select (row_number() over (order by sha256('3:' || vec_id)) - 1)::int as k, v as c from vectors order by sha256('3:' || vec_id) limit 8),{rounds}
        final as materialized ({nearest(10)})
        select vec_id, k as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
               sha256(array_to_string(c, ',')) as centroid_sha256
        from final join centroids10 using (k)"""
