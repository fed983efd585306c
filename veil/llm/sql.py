"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import decontamination
from .urls import HOST_RULES, PATTERN_RULES


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op4_url_filters() -> str:
    longest = sorted(HOST_RULES, key=lambda r: (-len(r.text), -len(r.host)))
    fits = lambda r: f"(host = {_quoted(r.host)} or ends_with(host, {_quoted('.' + r.host)})) and starts_with(path, {_quoted(r.path)})"
    rule = " ".join(f"when {fits(r)} then {_quoted(r.text)}" for r in longest)
    said = " ".join(f"when rule = {_quoted(r.text)} then {_quoted(r.verdict)}" for r in longest)
    method = " ".join(f"when regexp_matches(lower_url, {_quoted(r.regex)}) then {_quoted(r.verdict)}" for r in PATTERN_RULES)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with a as (
  select page_id, {lower("coalesce(url, '')")} as lower_url,
         case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select *, regexp_extract(rest, '^[^/?#]*') as raw_host from a),
c as (select page_id, lower_url, {lower("raw_host")} as host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from b),
d as (select *, case {rule} end as rule from c)
select page_id, host, path, rule, case {said} {method} else 'allow' end as verdict from d"""


#: Words of the contracts: runs of other than ASCII white space.
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _components(ids: str, links: str) -> str:
    """Recursive relation reach(id, other) over an undirected relation links(x, y)."""
    return f"""both_ways as (select x, y from {links} union all select y, x from {links}),
reach(id, other) as (select id, id from {ids} union select r.id, b.y from reach r join both_ways b on b.x = r.other)"""


def op2_ngram_jaccard_join() -> str:
    words = _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""with recursive w as (select doc_id, {words} as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w),
shingles as (select doc_id, unnest(s) as g from sets), n as (select doc_id as id, len(s) as n from sets),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.id = x join n q on q.id = y where 100 * c >= 75 * (p.n + q.n - c)),
{_components("n", "links")}
select n.id as doc_id, cast(n.n as bigint) as n_shingles, min(r.other) as component_id from n join reach r on r.id = n.id group by n.id, n.n"""


def op9_embedding_near_dedup() -> str:
    return f"""with recursive v as (select vec_id as id, label, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.id as x, b.id as y from ok a join ok b on a.label = b.label and a.id < b.id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
{_components("v", "links")},
degree as (select x, count(*) as k from both_ways group by x),
c as (select id, min(other) as component from reach group by id)
select c.id as vec_id, cast(coalesce(d.k, 0) as bigint) as n_links, c.component as component_id, c.id = c.component as kept from c left join degree d on d.x = c.id"""


def op10_substring_dedup() -> str:
    words = _WORDS.format(text="coalesce(text, '')")
    return f"""with w as (select doc_id, {words} as ws from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13),
windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from places),
firsts as (select g, min(doc_id) as least from windows group by g),
later as (select doc_id, i from windows join firsts using (g) where least < doc_id),
covered as (select distinct doc_id, i + k as pos from later, (select unnest(range(13)) as k) t),
each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
kept as (select e.doc_id, count(*) as n, string_agg(e.word, ' ' order by e.pos) as t from each e anti join covered c on c.doc_id = e.doc_id and c.pos = e.pos group by e.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""


def op7_benchmark_decontamination() -> str:
    name, number, unit, other = (_quoted(x.replace(")*+", ")*")) for x in (decontamination.NAME, decontamination.NUMBER, decontamination.UNIT, decontamination.OTHER))
    w, marks = decontamination.WINDOW, ", ".join(_quoted(x) for x in decontamination.PLACEHOLDERS)

    def prepared(table: str, key: str) -> str:
        return f"""(select {key}, t0, t1, t2, case when length(spaced) > 0 then regexp_split_to_array(spaced, ' +') else [] end as tokens,
  [list_transform(regexp_extract_all(t0, {name}, 2), lambda v: lower(v)), regexp_extract_all(t1, {number}, 0), list_transform(regexp_extract_all(t2, {unit}, 2), lambda v: lower(v))] as slots
from (select *, trim(regexp_replace(regexp_replace(lower(regexp_replace(t2, {unit}, '\\1 <unit>\\3', 'g')), '(<name>|<num>|<unit>)', ' \\1 ', 'g'), {other}, ' ', 'g')) as spaced
from (select *, regexp_replace(t1, {number}, '<num>', 'g') as t2 from (select *, regexp_replace(t0, {name}, '\\1<name>', 'g') as t1
from (select {key}, translate(text, '<>', '  ') as t0 from {table} where text is not null and {key} is not null) q0) q1) q2) q3)"""

    def values(side: str, start: str) -> str:
        one = lambda k: f"""list_transform(({side}.slots[{k + 1}])[len(list_filter({side}.tokens[1:{start}], lambda x: x = {_quoted(decontamination.PLACEHOLDERS[k])})) + 1 :
  len(list_filter({side}.tokens[1:{start} + {w}], lambda x: x = {_quoted(decontamination.PLACEHOLDERS[k])}))], lambda v: '{k}:' || v)"""  # noqa: E731
        return " || ".join(one(k) for k in range(3))

    enough = f"least({decontamination.ENOUGH}, ceil(windows / 2))"
    return f"""with items as (select * from {prepared("benchmark", "item_id")} i), docs as (select * from {prepared("documents", "doc_id")} d),
iw as (select item_id, k, array_to_string(tokens[k + 1:k + {w}], ' ') as g, len(list_filter(tokens[k + 1:k + {w}], lambda x: x not in ({marks}))) as plain
  from (select item_id, tokens, unnest(range(0, len(tokens) - {w - 1})) as k from items where len(tokens) >= {w}) a),
ix as (select item_id, k, g from iw where plain >= {decontamination.LITERALS}), usable as (select item_id, count(distinct g) as windows from ix group by item_id),
dw as (select doc_id, pos, array_to_string(tokens[pos + 1:pos + {w}], ' ') as g from (select doc_id, tokens, unnest(range(0, len(tokens) - {w - 1})) as pos from docs where len(tokens) >= {w}) a),
hits as (select doc_id, pos, item_id, k, g from dw join ix using (g)),
likely as (select doc_id, item_id, windows from (select doc_id, item_id, count(distinct g) as met from hits group by 1, 2) m join usable using (item_id) where met >= {enough}),
placed as (select h.doc_id, h.item_id, l.windows, h.g, {values("i", "h.k")} as iv, {values("d", "h.pos")} as dv
  from hits h join likely l using (doc_id, item_id) join items i on i.item_id = h.item_id join docs d on d.doc_id = h.doc_id),
counted as (select doc_id, item_id, windows, count(distinct g) as all_met, count(distinct case when len(iv) = 0 then g end) as plain_met from placed group by 1, 2, 3),
maps as (select doc_id, item_id, count(distinct i) as froms, count(distinct i || chr(0) || d) as pairs, coalesce(bool_or(i <> d), false) as changed
  from (select doc_id, item_id, unnest(iv) as i, unnest(dv) as d from placed) z group by 1, 2),
judged as (select doc_id, item_id, windows, case when coalesce(froms = pairs, true) then all_met else plain_met end as matched, coalesce(changed, false) as changed from counted left join maps using (doc_id, item_id))
select doc_id, item_id, matched, windows, changed from judged where matched >= {enough}"""


def oracles() -> dict[str, str]:
    found = (op2_ngram_jaccard_join, op4_url_filters, op7_benchmark_decontamination, op9_embedding_near_dedup, op10_substring_dedup)
    return {f.__name__: f() for f in found}
