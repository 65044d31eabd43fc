"""DuckDB statements for the operators that SQL can express."""

SPACE = r"[\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(string_split_regex({LOWER}, '{SPACE}'), lambda x: x <> '')"


def shingles(name: str, key: str) -> str:
    """Distinct five-word shingles ``s`` of each text of a table; shorter texts are one."""
    following = ", ".join(f"lead(w, {k}) over (partition by {key} order by i) w{k}" for k in range(1, 5))
    return f"""
    select distinct {key}, concat_ws(' ', w, w1, w2, w3, w4) s from (
        select {key}, i, n, w, {following} from (
            select {key}, unnest(w) w, generate_subscripts(w, 1) i, len(w) n from (select {key}, {WORDS} w from {name})
        )
    ) where i + 4 <= n or i = 1
"""


LINE_DEDUP = """
with lines as (
    select doc_id, coalesce(text, '') body, string_split(coalesce(text, ''), chr(10)) l from documents
), windows as (
    select doc_id, unnest(range(1, len(l) - 1)) p0, l from lines where len(l) >= 3
), hashed as (
    select doc_id, p0, array_to_string(l[p0:p0 + 2], chr(10)) w from windows
), later as (
    select doc_id, p0 from hashed qualify row_number() over (partition by w order by doc_id, p0) > 1
), covered as (
    select doc_id, list(distinct p) c from (select doc_id, unnest([p0, p0 + 1, p0 + 2]) p from later) group by doc_id
)
select d.doc_id,
       case when c is null then d.text
            else coalesce(array_to_string(list_filter(l, lambda x, i: not list_contains(c, i)), chr(10)), '') end as text,
       d.lang, d.source,
       case when c is null then d.n_chars
            else length(coalesce(array_to_string(list_filter(l, lambda x, i: not list_contains(c, i)), chr(10)), '')) end as n_chars,
       cast(len(l) as int) n_lines, cast(coalesce(len(c), 0) as int) n_removed
from documents d join lines using (doc_id) left join covered using (doc_id)
"""

LEAKS = f"""
with d as ({shingles("documents", "doc_id")}), b as ({shingles("benchmark", "item_id")}),
q as (select item_id, count(*) n_item_shingles from b group by item_id)
select doc_id, item_id, cast(n_item_shingles as int) n_item_shingles, count(*) n_shared,
       count(*) / n_item_shingles containment
from d join b using (s) join q using (item_id)
group by doc_id, item_id, n_item_shingles
having 4 * count(*) >= 3 * n_item_shingles
"""
