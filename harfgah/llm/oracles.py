"""DuckDB SQL for the queries of this package that SQL can express.

DuckDB has NFC but not NFKC, so the compatibility forms are resolved by a table that is made from the rule itself: every
character of the listed blocks whose NFKC differs. One-to-one forms go through translate, longer ones through replace.
"""

from __future__ import annotations

import unicodedata

from harfgah.functions.fold import DISPLAY, HAMZA_ABOVE, MATCH, ZWNJ, translate_sql
from harfgah.llm.text import INVISIBLE
from harfgah.plans.sqltools import quoted

# Letters of other alphabets that look like a Latin letter of the same case, as these tables have them.
TO_LATIN = {
    **dict(zip("АВЕІЈКМНОРСТУХЅԚԜаеіјорсухѕԁԛԝһ", "ABEIJKMHOPCTYXSQWaeijopcyxsdqwh", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳϲ", "ABEZHIKMNOPTYXojc", strict=True)),
    **dict(zip("ՏՍՕօսհ", "SUOouh", strict=True)),
}
#: Blocks with compatibility forms that are resolved: Latin-1, general punctuation, Arabic presentation forms, full-width forms.
BLOCKS = [(0xA0, 0x180), (0x2000, 0x2070), (0x3000, 0x3001), (0xFB50, 0xFDFE), (0xFE70, 0xFF00), (0xFF01, 0xFF5F)]
FORMS = {chr(c): f for a, b in BLOCKS for c in range(a, b) if (f := unicodedata.normalize("NFKC", chr(c))) != chr(c)}
ONE = {c: f for c, f in FORMS.items() if len(f) == 1}
#: Of the longer forms those of words and letters; the rest are marks or signs that can't stand in these texts' words.
LONG = {c: f for c, f in FORMS.items() if len(f) > 1 and (0xFEF5 <= ord(c) <= 0xFEFC or c in "…﷼")}
HIDDEN = "".join(sorted(INVISIBLE))


def looks_sql(x: str, form: dict[str, str]) -> str:
    """Invisible characters, compatibility forms and look-alikes resolved, then the project's letter map, composed."""
    x = f"translate({x}, {quoted(HIDDEN)}, '')"
    x = f"nfc_normalize({translate_sql(x, ONE | LONG)})"
    return f"nfc_normalize({translate_sql(x, TO_LATIN | form)})"


def folded_sql(x: str) -> str:
    return f"lower(replace(replace({looks_sql(x, MATCH.pairs())}, '{ZWNJ}', ''), '{HAMZA_ABOVE}', ''))"


WORD = r"[\p{L}\p{N}]+"


def words_sql(x: str) -> str:
    return f"coalesce(regexp_extract_all({folded_sql(x)}, '{WORD}', 0), [])"


def key_sql(x: str) -> str:
    return rf"coalesce(regexp_replace({folded_sql(x)}, '[^\p{{L}}\p{{N}}]+', '', 'g'), '')"


RECORDS = f"""(select example_id, {key_sql('latin')} as l, {key_sql('persian')} as p from (select example_id, latin, persian from example
 union all select example_id, json_extract_string(payload, '$.latin'), json_extract_string(payload, '$.persian') from example_raw where json_valid(payload)))"""

P2_FOUND = f"""
with r as materialized (select * from {RECORDS} where l <> '' or p <> ''), g as (select l, p, min(example_id) as first_id from r group by l, p having count(*) > 1)
select g.first_id, r.example_id from r join g on r.l = g.l and r.p = g.p where r.example_id <> g.first_id
"""
P2_GROUPS = f"select min(example_id) as first_id, count(*) as n_copies, l as latin, p as persian from {RECORDS} where l <> '' or p <> '' group by l, p"

TERMS = f"""(with t as materialized (select id, {words_sql('text')} as w from (select row_number() over () as id, text from (select persian as text from example union all select expected from chat_test))),
 o as (select id, unnest(w) as term from t), c as (select term, count(*) as n_occurrences, count(distinct id) as n_records from o group by term)
 select term, n_occurrences, n_records, case when n_records * 20 > (select count(*) from t) then 'common' when n_records < 3 then 'rare' end as mark from c)"""
P3_TERMS = f"select * from {TERMS}"
P3_FOUND = f"select term, mark from {TERMS} where mark is not null"

BLANK = r"[\s   -   　]+"
TIDY = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({{}}, '{ZWNJ}+', '{ZWNJ}', 'g'), '{ZWNJ}([\s   -   　\p{{{{P}}}}])', '\1', 'g'), '([\s   -   　\p{{{{P}}}}]){ZWNJ}', '\1', 'g'), '^{ZWNJ}|{ZWNJ}$', '', 'g')"
LOOKS = f"(select key, text, trim(regexp_replace({TIDY.format(looks_sql('text', DISPLAY.pairs()))}, '{BLANK}', ' ', 'g'), ' ') as form from (select norm_id as key, input as text from normalization union all select id, expected from chat_test))"
P4_FOUND = f"with l as materialized (select * from {LOOKS} where form <> '') select a.key as id_a, b.key as id_b from l a join l b on a.form = b.form and a.text <> b.text and a.key < b.key"

P6_FOUND = f"""
with e as materialized (select distinct id, array_to_string(w[i : i + 4], ' ') as gram from (select id, w, unnest(generate_series(1, len(w) - 4)) as i from (select id, {words_sql('expected')} as w from chat_test union all select id, {words_sql('input')} from chat_test))),
t as materialized (select distinct example_id, array_to_string(w[i : i + 4], ' ') as gram from (select example_id, w, unnest(generate_series(1, len(w) - 4)) as i from (select example_id, {words_sql('latin')} as w from example where split = 'train' union all select example_id, {words_sql('persian')} from example where split = 'train')))
select distinct e.id as eval_id, t.example_id from e join t using (gram)
"""

P9_FOUND = f"""
with d as materialized (select doc_id, {words_sql('text')} as w from documents), n as (select doc_id, w, len(w) as n from d where len(w) >= 5),
g as (select doc_id, i, array_to_string(w[i : i + 3], ' ') as gram from (select doc_id, w, unnest(generate_series(1, n - 3)) as i from n)),
r as (select doc_id, i from (select *, row_number() over (partition by doc_id, gram order by i) as k from g) where k > 1),
c as (select doc_id, count(distinct i + j) as covered from r, range(4) t(j) group by doc_id)
select n.doc_id from n join c using (doc_id) where covered * 10 >= n * 3
"""

P6_ITEMS = f"""
with f as (select id, 'answer' as field, {words_sql('expected')} as w from chat_test union all select id, 'question', {words_sql('input')} from chat_test),
e as materialized (select distinct id, field, array_to_string(w[i : i + 4], ' ') as gram from (select id, field, w, unnest(generate_series(1, len(w) - 4)) as i from f)),
t as materialized (select distinct example_id, source, array_to_string(w[i : i + 4], ' ') as gram from (select example_id, source, w, unnest(generate_series(1, len(w) - 4)) as i from (select example_id, source, {words_sql('latin')} as w from example where split = 'train' union all select example_id, source, {words_sql('persian')} from example where split = 'train'))),
p as (select e.id, t.source, t.example_id, bool_or(field = 'question') as q, bool_or(field = 'answer') as a from e join t using (gram) group by all)
select id as eval_id, source, count(*) as n_examples, count(*) filter (where q) as n_question, count(*) filter (where a) as n_answer, count(*) filter (where q and a) as n_both from p group by all
"""

#: The longest common sequence of the lists a and b, row by row of its table.
COMMON = """list_extract(list_reduce(list_concat([list_transform(range(len(b) + 1), lambda z: 0)], list_transform(a, lambda x: list_transform(b, lambda y: (x = y)::integer))),
 lambda row, fits: list_reduce(list_concat([[0]], list_transform(range(1, len(b) + 1), lambda j: [row[j] + fits[j], row[j + 1]])), lambda new, z: list_append(new, greatest(z[1], z[2], new[len(new)])))), -1)"""


def overlaps_sql(where: str) -> str:
    """id, eval_set, example_id, split, source and, of the best side, coverage and whether letters and digits are the same.

    Texts can only be near if they share two neighbouring words (overlap.py says why; the tests compare all pairs).
    """
    texts = lambda rows, carry: f"(select {carry}, side, {words_sql('text')} as w, {key_sql('text')} as k from {rows})"
    evals = "(select 'chat_test' as eval_set, id, unnest(['input', 'expected']) as side, unnest([input, expected]) as text from chat_test union all select 'authored', id, unnest(['input', 'expected']), unnest([input, expected]) from authored)"
    corpus = f"(select example_id, split, source, unnest(['input', 'expected']) as side, unnest([latin, persian]) as text from example where {where})"
    grams = "(select {0}, side, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as gram from {1} where len(w) >= 2)"
    return f"""(with e as materialized {texts(evals, 'eval_set, id')}, t as materialized {texts(corpus, 'example_id, split, source')},
    te as materialized (select row_number() over () as en, side, w from (select distinct side, w from e where len(w) >= 5)), tt as materialized (select row_number() over () as tn, side, w from (select distinct side, w from t where len(w) >= 4)),
    c as (select distinct en, tn from {grams.format('en', 'te')} x join {grams.format('tn', 'tt')} y using (side, gram)),
    n as materialized (select side, ew, tw, m / greatest(len(ew), len(tw)) as coverage from (select te.side, te.w as ew, tt.w as tw, a, b, {COMMON} as m from (select en, tn, te.w as a, tt.w as b from c join te using (en) join tt using (tn) where 4 * least(len(te.w), len(tt.w)) >= 3 * greatest(len(te.w), len(tt.w))) join te using (en) join tt using (tn)) where 4 * m >= 3 * greatest(len(ew), len(tw))),
    p as (select e.eval_set, e.id, t.example_id, t.split, t.source, 1.0::double as coverage, true as same, side from e join t using (side, k) where k <> ''
      union all select e.eval_set, e.id, t.example_id, t.split, t.source, coverage, false, n.side from n join e on e.side = n.side and e.w = n.ew join t on t.side = n.side and t.w = n.tw)
    select eval_set, id, example_id, any_value(split) as split, any_value(source) as source, max(coverage) as coverage, bool_or(same) as same from p group by eval_set, id, example_id)"""


P1_FOUND = f"select id as eval_id, example_id from {overlaps_sql(chr(39).join(['split = ', 'train', '']))}"
P1_RECORDS = f"select id as eval_id, count(*) as n_examples, round(max(coverage), 6) as coverage from {overlaps_sql(chr(39).join(['split = ', 'train', '']))} group by id"
P1_REPORT = f"select eval_set, split, source, count(*) as n_pairs, count(distinct id) as n_eval, count(distinct example_id) as n_examples, sum(same::integer)::bigint as n_same, round(avg(coverage), 6) as mean_coverage from {overlaps_sql('true')} group by all"

_TOKEN = r"(?:[\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Lisu}]\p{Mn}*)+"
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")
_N_SCRIPTS = " + ".join(rf"regexp_matches(x, '\p{{{s}}}')::integer" for s in _SCRIPTS)


def forms_sql(rows: str) -> str:
    tokens = f"coalesce(regexp_extract_all(text, '{_TOKEN}', 0), [])"
    form = f"trim(regexp_replace({TIDY.format(looks_sql('text', DISPLAY.pairs()))}, '{BLANK}', ' ', 'g'), ' ')"
    count = lambda test: f"len(list_filter({tokens}, lambda x: {test}))::integer"
    whole = rf"{_N_SCRIPTS} = 1 and regexp_full_match(regexp_replace(x, '\p{{Mn}}', '', 'g'), '[{''.join(TO_LATIN)}]+')"
    return f"select key, text, {form} as form, {count(f'{_N_SCRIPTS} > 1')} as mixed_tokens, {count(whole)} as whole_tokens, coalesce(length(text) - length(translate(text, {quoted(HIDDEN)}, '')), 0)::integer as invisible from {rows}"


P4_FORMS = forms_sql("(select norm_id as key, input as text from normalization union all select id, expected from chat_test union all select 'output:' || norm_id, output from normalization)")

_LINES = r"[\n\r\v\f\x{85}\x{2028}\x{2029}]"
_KS = (2, 4, 6, 8, 10)


def _covered_sql(k: int) -> str:
    return f"""c{k} as (select doc_id, count(*) as words, sum(length(w[place]))::bigint as chars from (select distinct doc_id, w, i + j as place from (select doc_id, w, i, row_number() over (partition by doc_id, array_to_string(w[i : i + {k - 1}], ' ') order by i) as nth
      from (select doc_id, w, unnest(generate_series(1, len(w) - {k - 1})) as i from d)), range({k}) t(j) where nth > 1) group by doc_id)"""


P9_SHARES = f"""
with f as materialized (select doc_id, string_split_regex(coalesce({folded_sql('text')}, ''), '{_LINES}') as rows from documents),
l as materialized (select doc_id, n, regexp_extract_all(rows[n], '{WORD}', 0) as w from (select doc_id, rows, unnest(generate_series(1, len(rows))) as n from f)),
d as materialized (select doc_id, flatten(list(w order by n)) as w from l group by doc_id),
b as (select doc_id, sum(length(array_to_string(w, '')))::bigint as chars from (select doc_id, w, row_number() over (partition by doc_id, array_to_string(w, ' ') order by n) as nth from l where len(w) > 0) where nth > 1 group by doc_id),
{', '.join(map(_covered_sql, _KS))}
select d.doc_id, len(w)::bigint as n_words, {', '.join(f'round(coalesce(c{k}.words / nullif(len(w), 0), 0), 6) as word_share_{k}, round(coalesce(c{k}.chars / nullif(length(array_to_string(w, %s)), 0), 0), 6) as char_share_{k}' % "''" for k in _KS)},
 round(coalesce(b.chars / nullif(length(array_to_string(w, '')), 0), 0), 6) as line_share from d left join b using (doc_id) {' '.join(f'left join c{k} using (doc_id)' for k in _KS)}
"""

#: Decoding gives back every text; a null one has no ids, so it comes back empty.
P7_TEXTS = "select doc_id, coalesce(text, '') as text from documents"

ORACLES: dict[str, str] = {"p1_found": P1_FOUND, "p1_records": P1_RECORDS, "p1_report": P1_REPORT, "p4_forms": P4_FORMS, "p6_items": P6_ITEMS, "p7_texts": P7_TEXTS, "p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p3_found": P3_FOUND, "p3_terms": P3_TERMS, "p4_found": P4_FOUND, "p6_found": P6_FOUND, "p9_found": P9_FOUND, "p9_shares": P9_SHARES}
