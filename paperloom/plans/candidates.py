"""Queries of candidate answers: boards over sales reports and over retrieved document blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import candidates as K
from ..operators import checks as C
from . import evidence as P
from . import fixtures as X
from .evidence import NORM
from .registry import query

#: Questions about a client, one kind for each remainder of its number.
ASKED = (
    "What is the source cited at the bottom of the sales report?", "What heading or title does the report have?", "Which city is the board located in?", "Which state is the address in?", "What is the short form of quarter 1 in the report?",
    "Which company or board paid?", "What percentage is the tax rate?", "On what date was it paid?", "What is the total amount of the client?", "Which index is given in the tax rate row?", "Who was it?", "What is the client name?",
)
REGIONS = ("Ohio", "New York", "TX", "Utah")
SPANS_EACH = 12


def quoted(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def report_spans(spark, sf_dir):
    """The latest sales of each client as reports in text: qid, candidate_id, text, score, page_rank, top, and the question as asked() reads it, once a client."""
    last = Window.partitionBy("client_id").orderBy(F.desc_nulls_last("sold_at"), F.desc("sale_id"))
    sales = X.table(spark, sf_dir, "sales").where("client_id is not null and sale_id is not null").dropDuplicates(["client_id", "sale_id"])
    latest = sales.withColumn("page_rank", F.row_number().over(last)).where(F.col("page_rank") <= SPANS_EACH)
    clients = X.table(spark, sf_dir, "clients").groupBy("client_id").agg(*[F.coalesce(F.min(c), F.lit("")).alias(c) for c in ("name", "email", "city")], F.coalesce(F.min("nation_id"), F.lit(0)).alias("nation_id"))
    # Rows are short and their texts take long to read, so tasks may not be as few as bytes would fill. Into as many partitions as before nothing would be dealt anew: one more.
    parts = 1 + max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    question = F.get(F.array(*map(F.lit, ASKED)), (F.col("client_id") % len(ASKED)).cast("int"))
    rows = latest.repartition(parts, "client_id").join(K.asked(clients.withColumn("question", question)), "client_id")
    n, text = F.col("sale_id"), lambda c: F.col(c).cast("string")
    region = F.get(F.array(*map(F.lit, REGIONS)), F.col("nation_id") % len(REGIONS))
    source = F.when(n % 3 == 0, F.concat(F.lit("Source: https://shop.example.net/s/"), text("sale_id"))).when(n % 3 == 1, F.concat(F.lit("Cited - USMM"), text("sale_id"))).otherwise(F.concat(F.lit("Footer: "), F.col("email")))
    lines = [
        F.concat(F.lit("Sales Report "), F.col("city")), source, F.concat(F.lit("Client name: "), F.col("name")), F.concat(F.lit("Board located in "), F.col("city"), F.lit(", "), region),
        F.concat(F.lit("Q"), F.coalesce(F.quarter("sold_at"), F.lit(1)).cast("string"), F.lit("FY24 total amount $"), F.format_string("%.2f", F.coalesce(F.nanvl("total", F.lit(0.0)), F.lit(0.0)))),
        F.concat(F.lit("Tax rate "), F.coalesce(text("priority"), F.lit("0")), F.lit(".5% ("), (n % 90).cast("string"), F.lit(") of 1,234 in row "), (n % 400).cast("string")),
        F.concat(F.lit("Paid on "), F.coalesce(F.date_format("sold_at", "yyyy-MM-dd"), F.lit("no day")), F.lit(" by GLOBAL TRADE OFFICE of "), F.col("name"), F.lit(" Company")),
    ]
    return rows.select(F.col("client_id").alias("qid"), *("question", "keywords", "fields", "numbers", "target"), F.format_string("c%02d", "page_rank").alias("candidate_id"), F.concat_ws("\n", *lines).alias("text"), (1 / F.col("page_rank")).alias("score"), "page_rank", F.when(n % 2 == 0, 100).alias("top"))


REPORTS = f"""named as (select client_id, coalesce(min(name), '') as name, coalesce(min(email), '') as email, coalesce(min(city), '') as city, coalesce(min(nation_id), 0) as nation_id from clients group by 1),
latest as (select * from (select *, row_number() over (partition by client_id order by sold_at desc nulls last, sale_id desc) as page_rank from (select distinct on (client_id, sale_id) * from sales where client_id is not null and sale_id is not null)) where page_rank <= {SPANS_EACH}),
spans as (select client_id as qid, {quoted(ASKED)}[client_id % {len(ASKED)} + 1] as question, printf('c%02d', page_rank) as candidate_id, 1 / page_rank as score, page_rank, case when sale_id % 2 = 0 then 100 end as top,
  concat_ws(chr(10), 'Sales Report ' || city, case sale_id % 3 when 0 then 'Source: https://shop.example.net/s/' || sale_id when 1 then 'Cited - USMM' || sale_id else 'Footer: ' || email end, 'Client name: ' || name, 'Board located in ' || city || ', ' || {quoted(REGIONS)}[nation_id % {len(REGIONS)} + 1],
  'Q' || coalesce(quarter(sold_at), 1) || 'FY24 total amount $' || printf('%.2f', coalesce(case when isnan(total) then 0 else total end, 0)), 'Tax rate ' || coalesce(priority, 0) || '.5% (' || sale_id % 90 || ') of 1,234 in row ' || sale_id % 400,
  'Paid on ' || coalesce(strftime(sold_at, '%Y-%m-%d'), 'no day') || ' by GLOBAL TRADE OFFICE of ' || name || ' Company') as text from latest join named using (client_id))"""

BLOCK_SPANS = "spans as (select qid, question, printf('c%02d', rank) as candidate_id, 1 / rank as score, rank as page_rank, null as top, text from best)"


def block_spans(spark, sf_dir):
    """The ten best blocks of each question."""
    rank = F.col("rank")
    return P.best(spark, sf_dir).select("qid", "question", F.format_string("c%02d", "rank").alias("candidate_id"), "text", (1 / rank).alias("score"), rank.alias("page_rank"), F.lit(None).cast("int").alias("top"))


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def norm(v: str) -> str:
    return NORM.format(v)


def answer(v: str) -> str:
    return NORM.format(f"translate({v}, ',$', '')")


def words(v: str) -> str:
    return f"list_filter(string_split({norm(v)}, ' '), lambda w: w <> '')"


def short(v: str, most: int = 12, chars: int = 90) -> str:
    return f"(trim({v}) <> '' and length(trim({v})) <= {chars} and len({words(v)}) <= {most} and len(list_filter({words(v)}, lambda w: w not in ({', '.join(map(lit, C.SHORT_STOPWORDS))}))) > 0)"


def stripped(v: str, marks: str = "' .;' || chr(9)") -> str:
    return f"trim({v}, {marks})"


def value(v: str) -> str:
    return stripped(f"regexp_replace({stripped(v)}, '(?s)(\\s{{2,}}|\\t|<|>).*$', '')")


def head(v: str) -> str:
    return f"({short(v, 14, 110)} and not regexp_full_match({v}, {lit(K.NUMBER)}) and {norm(v)} not in ({', '.join(map(lit, C.NO_HEADINGS))}) and (len({words(v)}) >= 2 or regexp_matches({v}, '\\p{{L}}')))"


def got(values: str, rule: str, kind: str, worth: str | float) -> str:
    return f"list_transform({values}, lambda v: {{'rule': '{rule}', 'kind': '{kind}', 'value': v, 'worth': {worth}::double}})"


def every(pattern: str, group: int = 0, text: str = "text") -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def has(names) -> str:
    return f"list_has_any(fields, {quoted(names)})"


def gate(kind: str, *names: str) -> str:
    return f"(target = '{kind}' or {has(names or (kind,))})"


def within(text: str, terms) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(t)})" for t in terms) + ")"


def covers(held: str, part: str) -> str:
    return f"({held} = {part} or ({held} <> '' and {part} <> '' and contains(' ' || {held} || ' ', ' ' || {part} || ' ')))"


LETTER = r"[\p{L}\p{N}_.]"
#: Without lookaround: a sign after a letter and a comma that parts no thousands become marks, and marks are doubled, so that two numbers may share one.
ALONE = (
    r"regexp_extract_all(regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_.])-', '\1;', 'g'), ',(\d{3})', chr(1) || '\1', 'g'), ',', ';'), chr(1), ','), '([^\p{L}\p{N}_.,-])', '\1\1', 'g'), "
    rf"'(?:^|[^\p{{L}}\p{{N}}_.])({K.NUMBER})(?:[^\p{{L}}\p{{N}}_.]|$)', 1)"
)


def lone(v: str) -> str:
    return f"regexp_matches({v}, '(?:^|[^\\p{{L}}\\p{{N}}_.]){K.NUMBER}(?:[^\\p{{L}}\\p{{N}}_.]|$)')"


def kind_of(field: str, v: str) -> str:
    return f"""case when contains(lower({field}), 'quarter') or regexp_matches({v}, {lit(K.QUARTER)}) then 'quarter' when regexp_matches({v}, {lit(K.PERCENT)}) then 'percentage' when {lone(v)} then 'numeric'
when target in ('location', 'quarter', 'organization', 'heading', 'source') then target when contains(lower({field}), 'city') then 'city' when contains(lower({field}), 'state') then 'state' when {within(f'lower({field})', ('company', 'board', 'organization', 'agency', 'name'))} then 'organization'
when {within(f'lower({field})', ('date', 'year'))} then 'date' when {has(('company', 'board', 'organization', 'agency', 'name'))} then 'organization' else 'key_value' end"""


def first_line(most: int, chars: int) -> str:
    sentence = stripped("regexp_extract(trim(text), '^([^.;\\n]*)', 1)")
    return f"coalesce(list_filter(list_transform(lines, lambda x: {stripped('x')}), lambda x: {short('x', most, chars)})[1], case when {short(sentence, most, chars)} then {sentence} end)"


HINTED = "case " + " ".join(f"when {within('low', terms)}{extra} then '{name}'" for (name, terms), extra in zip(K.HINTS, (f" or regexp_matches(question, {lit(K.ASKED_DATE)})", "", "", f" or list_has_any(all_words, {quoted(K.TABLE_TERMS)}) or contains(low, '%')", ""), strict=True)) + " else 'unknown' end"
FIELDS = "list_filter([" + ", ".join([f"case when contains(low, '{t}') then '{t}' end" for t in K.FIELD_TERMS] + [f"case when {within('low', terms)} then '{name}' end" for name, terms in K.BOARD_FIELDS]) + "], lambda x: x is not null)"
NONE = "[]::struct(rule varchar, kind varchar, value varchar, worth double)[]"
CONTEXT = "case when len(list_filter(keywords, lambda k: length(k) > 2 and contains(lower(x), k))) > 0 then 0.16 when len(list_filter(fields, lambda k: contains(lower(x), k))) > 0 then 0.14 else 0 end"


def board_sql() -> str:
    """Views from `spans` to `board`."""
    line_sources = f"{got(f'list_filter([left(y, 220)], lambda v: regexp_matches(y, {lit(K.SOURCE_LINE)}))', 'source_line', 'source', 0.32)} || {got(every(K.URL, text='y'), 'source_url', 'source', 0.3)} || {got(f'{every(K.USMM, text="y")}[1:1]', 'source_usmm', 'source', 0.24)}"
    delimited_name, delimited = f"trim(regexp_extract(y, {lit(K.KEY_VALUE)}, 1))", value(f"regexp_extract(y, {lit(K.KEY_VALUE)}, 2)")
    tail = value(stripped("substr(y, strpos(lower(y), k) + length(k))", "' :-–—' || chr(9)"))
    meant = f"(len(keywords) = 0 or len(list_filter(keywords, lambda k: contains(lower(y), k))) > 0 or {has(('name', 'company', 'board', 'city', 'state', 'quarter'))})"
    typed = " || ".join(got(every(p, g), rule, kind, worth) for p, g, rule, kind, worth in ((K.PARENTHESIZED, 1, "parenthesized_index", "index", 0.28), (K.PERCENT, 0, "percentage", "percentage", 0.22), (K.DATE, 0, "date", "date", 0.2), (K.MONEY, 0, "money", "numeric", 0.19)))
    numeric, place = f"kind in ({', '.join(map(lit, K.NUMERIC))})", f"kind in ({', '.join(map(lit, K.PLACES))})"
    return f"""questions_ as (select *, list_filter(list_distinct_(all_words), lambda w: length(w) > 1 and w not in ({', '.join(map(lit, K.QUESTION_STOPWORDS))})) as keywords, {HINTED} as hint, {FIELDS} as fields,
  {every(K.ASKED_NUMBER, text='question')} || {every(K.ASKED_ORDINAL, text='low')} as numbers from (select distinct qid, question, lower(question) as low, {every(K.WORD, text='lower(question)')} as all_words from spans)),
targets as (select *, case when list_contains(fields, 'index') then 'index' when {has(K.PLACE_FIELDS)} then 'location' when list_contains(fields, 'quarter') then 'quarter' when {has(K.NAME_FIELDS)} then 'organization' when {has(('percentage', 'percent'))} then 'percentage' else hint end as target from questions_),
lined as (select s.*, t.keywords, t.fields, t.numbers, t.target, string_split_regex(text, {lit(K.LINE_ENDS)}) as lines, case when top <= 160 then 0.06 else 0 end as high from spans s join targets t using (qid)),
typed as (select *, {typed} as typed, {first_line(14, 110)} as opening, {first_line(10, 80)} as brief, list_filter(list_transform(lines[1:4], lambda x: {stripped('x')}), lambda x: {head('x')})[1:2] as titles, {ALONE} as loose from lined),
plain as (select *, list_transform(loose, lambda v: {answer('v')}) as loose_plain, list_transform(typed, lambda c: {answer('c.value')}) as typed_plain from typed),
special as (select *, (case when {gate('source')} then flatten(list_transform(lines, lambda z: list_transform([trim(z)], lambda y: {line_sources})[1])) else {NONE} end)
 || (case when {gate('heading')} then case when len(titles) > 0 then {got('titles', 'heading_short_title', 'heading', '(0.34 + high)')} else {got(f'list_filter([opening], lambda v: v is not null and {head("v")})', 'heading_first_line', 'heading', '(0.26 + high)')} end else {NONE} end)
 || (case when {gate('location', *K.PLACE_FIELDS)} then flatten(list_transform(list_zip({every(K.CITY_STATE, 1)}, {every(K.CITY_STATE, 2)}), lambda x:
   (case when list_contains(fields, 'city') or not list_contains(fields, 'state') then [{{'rule': 'address_city', 'kind': 'city', 'value': trim(x[1]), 'worth': 0.3::double}}] else {NONE} end) || (case when list_contains(fields, 'state') or not list_contains(fields, 'city') then [{{'rule': 'address_state', 'kind': 'state', 'value': trim(x[2]), 'worth': 0.3::double}}] else {NONE} end)))
   || {got(f'list_filter(list_transform({every(K.PLACE_LINE, 1)}, lambda v: {value("v")}), lambda v: {short("v", 8, 80)})', 'location_context_phrase', 'location', 0.22)} else {NONE} end)
 || (case when {gate('quarter')} then {got(f'list_transform({every(K.QUARTER)}, lambda v: trim(v))', 'quarter_short_form', 'quarter', "(case when len(list_filter(numbers, lambda n: n <> '' and contains(v, n))) > 0 then 0.39 else 0.31 end)")} else {NONE} end)
 || (case when {gate('organization', *K.NAME_FIELDS)} then {got(f'list_filter(list_transform({every(K.SUFFIXED, 1)}, lambda v: trim(v)), lambda v: {short("v", 10, 100)})', 'organization_suffix', 'organization', 0.29)} || {got(f'list_filter(list_transform({every(K.CAPITALS, 1)}, lambda v: trim(v)), lambda v: {short("v", 8, 90)})', 'uppercase_organization_phrase', 'organization', 0.2)} else {NONE} end)
 || flatten(list_transform(list_transform(lines, lambda x: trim(x)), lambda y: case when regexp_matches(y, {lit(K.KEY_VALUE)}) then list_transform(list_filter([{delimited}], lambda v: {short('v', 12, 100)} and {meant}), lambda v: {{'rule': 'key_value_delimited', 'kind': {kind_of(delimited_name, 'v')}, 'value': v, 'worth': 0.24::double}})
   else list_filter(list_transform(list_filter(keywords, lambda k: length(k) > 2 and contains(lower(y), k)), lambda k: {{'rule': 'key_value_adjacent', 'kind': {kind_of('k', tail)}, 'value': {tail}, 'worth': 0.18::double}}), lambda c: {short('c.value', 10, 80)}) end))
 || typed || list_transform(list_filter(range(1, len(loose) + 1), lambda i: len(list_filter(typed_plain, lambda h: {covers('h', 'loose_plain[i]')})) = 0 and not list_contains(loose_plain[1:i - 1], loose_plain[i])),
   lambda i: {{'rule': case when list_contains(fields, 'index') and {within('lower(text)', K.INDEX_WORDS)} then 'index_context_number' else 'numeric' end, 'kind': case when list_contains(fields, 'index') and {within('lower(text)', K.INDEX_WORDS)} then 'index' else 'numeric' end, 'value': loose[i], 'worth': 0.16::double}}) as special from plain),
found as (select *, special || case when target in ('text', 'unknown') or len(special) = 0 then {got(f"list_filter(list_transform({every(K.COLON_VALUE, 1)}, lambda v: {stripped('v')}) || list_filter([brief], lambda v: v is not null), lambda v: {short('v')})[1:2]", 'generic_short_text', 'text', 0.11)} else {NONE} end as found from special),
each as (select * from (select qid, target, candidate_id, text, lines, keywords, fields, score, page_rank, pos, found[pos].rule as rule, found[pos].kind as kind, found[pos].value as value, found[pos].worth as worth, {answer('found[pos].value')} as plain from (select *, unnest(range(1, len(found) + 1)) as pos from found)) where plain <> ''),
near as (select *, coalesce(list_filter(list_transform(list_filter(lines, lambda x: contains(x, value)), lambda x: {CONTEXT}), lambda w: w > 0)[1], 0) as local, regexp_full_match(plain, '-?\\d+(\\.\\d+)?') as figure, case when regexp_full_match(plain, '-?\\d+(\\.\\d+)?') then plain::double end as number, trim(value) as shown, {numeric} as num, {place} as place from each),
weighed as (select *, (case when coalesce(number = floor(number) and (number between 1900 and 2100 or (number between 0 and 300 and {within('lower(text)', K.SEQUENCE_WORDS)})), false) then 0.22 else 0 end) + (case when local > 0 or len(list_filter(lines, lambda x: contains(x, value) and {within('lower(x)', K.VALUE_WORDS)})) > 0 then 0 else 0.2 end) as loose,
  length(regexp_replace(shown, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as telling, {norm('shown')} as shown_plain from near),
parted as (select *, greatest(0, least(score, 1)) * 0.35 as p1, case when len(keywords) > 0 then least(len(list_filter(keywords, lambda k: contains(lower(text), k))) / len(keywords), 1) * 0.2 else 0 end as p2,
  case when kind = target then 0.3 when target = 'location' and place then 0.28 when target = 'numeric' and num then 0.16 when target = 'unknown' then 0.04 else 0 end as p3,
  case when kind = 'index' and list_contains(fields, 'index') then 0.3 when kind = 'percentage' and {has(('percentage', 'percent', 'rate', 'share'))} then 0.25 when kind in ('source', 'heading') and list_contains(fields, kind) then 0.3 when place and {has(K.PLACE_FIELDS)} then 0.3 when kind = 'quarter' and list_contains(fields, 'quarter') then 0.3
   when kind = 'organization' and {has((*K.NAME_FIELDS, 'name'))} then 0.28 when kind = 'key_value' and len(fields) > 0 then 0.12 when kind = 'date' and list_contains(fields, 'date') then 0.22 when kind = 'numeric' and {has(('total', 'amount', 'rate', 'value'))} then 0.16 else 0 end as p4,
  case when page_rank > 0 then greatest(0, 0.22 - 0.04 * (page_rank - 1)) else 0 end as p6,
  -case when not num or rule in ('parenthesized_index', 'percentage', 'money') then 0 when target in ('numeric', 'index', 'percentage', 'quarter') then least(loose + 0.04, 0.32) else least(loose + 0.25, 0.6) end as p8,
  -case when target = 'unknown' or kind = target or (target = 'location' and place) or (target = 'numeric' and num) then 0 when target = 'percentage' then case when num then 0.3 else 0.12 end when target = 'index' and num then case when figure then 0 else 0.16 end when target in ('heading', 'source', 'text', 'location', 'organization') and num then 0.34 else 0.1 end as p9,
  -case when length(value) > 100 or len({words('value')}) > 14 then 0.18 when length(value) > 70 or len({words('value')}) > 10 then 0.08 else 0 end as p10,
  -case when telling = 0 then 0.3 when telling / greatest(length(shown), 1) < 0.45 then 0.18 when length(shown_plain) <= 1 then 0.2 when regexp_full_match(shown_plain, '[a-z]\\d?|[ivx]+') then 0.14 else 0 end as p11 from weighed),
summed as (select *, round(round(p1, 6) + round(p2, 6) + p3 + p4 + local + round(p6, 6) + worth + round(p8, 6) + p9 + p10 + p11, 6)::double as raw from parted),
repeated as (select *, round(raw - case when nth = 0 then 0 else least(0.08 + 0.07 * nth, 0.35) end, 6) as left_ from (select *, row_number() over (partition by qid, plain order by raw desc, candidate_id, pos) - 1 as nth from summed)),
reasoned as (select *, list_filter([case when num and target not in ('numeric', 'index', 'percentage', 'date', 'quarter', 'unknown') then case when left_ < 0.55 or local <= 0 then 'drop:generic_numeric_type_mismatch' else 'downrank:numeric_type_mismatch' end end,
  case when target = 'percentage' and num and kind <> 'percentage' then 'drop:non_percentage_numeric' end, case when target = 'index' and num and rule <> 'parenthesized_index' then 'downrank:non_parenthesized_index_numeric' end, case when p10 < -0.15 then 'downrank:long_text' end, case when p11 < -0.15 then 'drop:noisy_fragment' end, case when num and p8 < -0.4 then 'drop:weak_numeric_context' end], lambda x: x is not null) as reasons from repeated),
judged as (select *, round(left_ - least(list_sum([0.0::double] || list_transform(reasons, lambda r: case when starts_with(r, 'drop:') then 0.45 else 0.18 end)), 1), 6) + 0.0 as final, len(list_filter(reasons, lambda r: starts_with(r, 'drop:'))) = 0 as eligible from reasoned),
board as (select *, row_number() over w as rank, case when eligible then count(*) filter (eligible) over (w rows unbounded preceding) end as candidate_rank from judged window w as (partition by qid order by final desc, candidate_id, kind, shown, pos))""".replace("list_distinct_(all_words)", "list_transform(list_filter(range(1, len(all_words) + 1), lambda i: not list_contains(all_words[1:i - 1], all_words[i])), lambda i: all_words[i])")


PARTS = "round(p1, 6)::double as source_score, round(p2, 6)::double as keyword_overlap, p3::double as type_match, p4::double as field_match, local::double as local_context, round(p6, 6)::double as rank_bonus, worth::double as worth, round(p8, 6)::double as generic_numeric, p9::double as type_mismatch, round(left_ - raw, 6)::double as duplicate, p10::double as long_text, p11::double as noisy_text"
SHORT_NAMES = {"source_candidate_score": "source_score", "question_keyword_overlap": "keyword_overlap", "answer_type_match": "type_match", "field_hint_match": "field_match", "local_context_match": "local_context", "span_rank_bonus": "rank_bonus", "extraction_rule_priority": "worth", "generic_numeric_penalty": "generic_numeric", "type_mismatch_penalty": "type_mismatch", "long_text_penalty": "long_text", "noisy_text_penalty": "noisy_text"}
BOARD = "select qid, rank, candidate_rank, candidate_id, target, rule, kind, shown as value, final as score, array_to_string(reasons, ',') as reasons from board"


def shown(board):
    return board.select("qid", "rank", "candidate_rank", "candidate_id", "target", "rule", "kind", "value", "score", F.array_join("reasons", ",").alias("reasons"))


@query(BOARD, REPORTS, board_sql())
def report_answer_boards(spark, sf_dir):
    """All candidates of the sales reports, every generator among them."""
    return shown(K.boards(report_spans(spark, sf_dir)))


@query(f"select qid, rank, {PARTS} from board", REPORTS, board_sql())
def report_answer_scores(spark, sf_dir):
    """The twelve parts of their scores."""
    board = K.boards(report_spans(spark, sf_dir))
    return board.select("qid", "rank", *[F.col(f"parts.{name}").alias(short_) for name, short_ in SHORT_NAMES.items()], F.col("duplicate_penalty").alias("duplicate"))


@query(BOARD, *P.BEST, BLOCK_SPANS, board_sql())
def document_answer_boards(spark, sf_dir):
    """Candidates of the document blocks that answer the questions best."""
    return shown(K.boards(block_spans(spark, sf_dir)))


@query("""select target, count(*) as candidates, count(distinct qid) as boards, count(*) filter (rank <= 20) as top20, count(distinct (qid, plain)) as different, count(*) filter (kind in ('numeric', 'percentage', 'index')) as numeric, count(*) filter (eligible) as eligible from board group by 1""", REPORTS, board_sql())
def answer_board_stats(spark, sf_dir):
    """Boards by what is asked for. A board's different answers are counted in it first."""
    board = K.boards(report_spans(spark, sf_dir))
    each = board.groupBy("target", "qid").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 20).alias("top"), F.countDistinct("plain").alias("plain"), F.count_if(F.col("kind").isin(*K.NUMERIC)).alias("num"), F.count_if("eligible").alias("ok"))
    return each.groupBy("target").agg(F.sum("n").alias("candidates"), F.count("*").alias("boards"), F.sum("top").alias("top20"), F.sum("plain").alias("different"), F.sum("num").alias("numeric"), F.sum("ok").alias("eligible"))
