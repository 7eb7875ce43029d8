"""The rules and input tables once more, as DuckDB SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from catalog.fixtures import CATEGORIES, FOCAL_ACTORS, FOCALS, FRAMES, MAP_ENTRIES
from frameloom.contract import SCORING_NAMES, TASK_LABELS
from frameloom.functions.prompts import pieces
from frameloom.functions.text import WHITE_SPACE

SEED = 42


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(items: Sequence) -> str:
    return "[" + ", ".join(lit(item) for item in items) + "]"


def pick(number: str, items: Sequence) -> str:
    return f"list_extract({values(items)}, cast(({number}) % {len(items)} as bigint) + 1)"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {lit(WHITE_SPACE)})"


def normalize(x: str) -> str:
    return f"case when lower({strip(x)}) like 'no categor%' then 'No Category' else {strip(x)} end"


def profile(x: str) -> str:
    return f"case when lower({strip(x)}) in ('nan','none','null') then '' else {normalize(x)} end"


def display(x: str) -> str:
    return f"case when {x} = '' then '[blank]' else {x} end"


def scoring(x: str) -> str:
    names = "".join(f" when {lit(long)} then {lit(short)}" for long, short in SCORING_NAMES.items())
    return (
        f"case when lower({strip(x)}) in ('nan','none','null') then '' "
        f"else coalesce(case lower({strip(x)}){names} end, {strip(x)}) end"
    )


def fold(x: str) -> str:
    bare = f"regexp_replace({x}, '\\([^()]*\\)', '', 'g')"
    kept = f"regexp_replace(lower(strip_accents({bare})), '[^a-z0-9\\s]+', '', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


def cut(x: str, limit: int) -> str:
    whole = strip(x)
    head = f"regexp_replace(substring({whole}, 1, {limit}), ' [^ ]*$', '')"
    return f"case when length({whole}) <= {limit} then {whole} else {head} || ' ...' end"


def parse(x: str) -> str:
    """Good for replies whose list items hold no commas."""
    text = strip(x)
    inside = f"regexp_extract({text}, '(?s)\\[(.*?)\\]', 1)"
    piece = (
        f"case when regexp_matches({text}, '(?s)\\[(.*?)\\]') then split_part({inside}, ',', 1) "
        f"else split_part({text}, chr(10), 1) end"
    )
    return f"""trim(trim({strip(piece)}, '"'), '''')"""


def read(x: str) -> str:
    return normalize(parse(x))


def match(x: str, labels: Sequence[str]) -> str:
    folded = f"lower(regexp_replace({normalize(x)}, '\\s+', ' ', 'g'))"
    whens = "".join(f" when {lit(label.lower())} then {lit(label)}" for label in labels)
    return f"case {folded}{whens} end"


def render(template: str, fields: dict[str, str]) -> str:
    parts = []
    for fixed, field in pieces(template):
        if fixed:
            parts.append(lit(fixed))
        if field:
            parts.append(f"coalesce(cast({fields[field]} as varchar), '')")
    return "(" + " || ".join(parts) + ")"


def digest(*parts: str, seed: int = SEED) -> str:
    texts = ", ".join(f"coalesce(cast({part} as varchar), '')" for part in parts)
    return f"md5(concat_ws(chr(31), {texts}, '{seed}'))"


def percent(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then 100.0::double * {part} / {whole} else 0.0::double end"


def frame(task: str, key: str = "doc_id") -> str:
    by, labels = FRAMES[task]
    return pick(f"{key} // {by}", labels)


COUNTRY = "case when category like 'China_%' then 'China' when category like 'RF_%' then 'Russia' end"
ACCOUNT = "case when category like '%Media%' then 'Media' when category like '%Diplomat%' then 'Diplomatic' end"
HAS_TEXT = "text is not null and trim(text) <> ''"
STATE = "(category like 'China_%' or category like 'RF_%')"
FOCAL = (
    f"case when (doc_id // 3) % {len(FOCALS) + 1} = {len(FOCALS)} "
    f"then regexp_extract(text, '\\p{{L}}+', 0) || ';' || source "
    f"else {pick(f'(doc_id // 3) % {len(FOCALS) + 1}', FOCALS)} end"
)
_MAP = f"(doc_id // 2) % {len(MAP_ENTRIES) + 1}"
_OTHER = f"{_MAP} = {len(MAP_ENTRIES)}"
_LABELS, _TARGETS, _COUNTS = (list(part) for part in zip(*MAP_ENTRIES))


def _collapsed(x: str) -> str:
    return f"regexp_replace(trim(coalesce({x}, '')), '[ \\t\\n\\f\\r]+', ' ', 'g')"


MERGE_KEY = (
    f"sha256(concat_ws(chr(31), {_collapsed('source')}, {_collapsed('link')}, "
    f"{_collapsed('standardized_date')}, {_collapsed('text')}))"
)

# name -> (tables it reads, query)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_posts": (
        (),
        f"""select doc_id as post_id, lang as source, {pick('doc_id', CATEGORIES)} as category,
          '' as link, '' as standardized_date, text,
          cast(2018 + doc_id % 9 as integer) as post_year, cast(1 + doc_id % 12 as integer) as post_month,
          {pick('doc_id // 2', FOCAL_ACTORS)} as focal_actor,
          {frame('aut')} as aut_frame, {frame('dem')} as dem_frame, {frame('west')} as west_frame,
          {FOCAL} as focal
        from documents""",
    ),
    "posts": (
        ("raw_posts",),
        """select *, row_number() over (partition by merge_key order by post_id) as key_occurrence
        from (select *, """
        + MERGE_KEY
        + """ as merge_key from raw_posts)""",
    ),
    "applications": (
        ("posts",),
        f"""select * from (
          select p.* exclude (aut_frame, dem_frame, west_frame), f.frame_domain, f.frame_subframe,
            {COUNTRY} as source_country, {ACCOUNT} as account_type
          from posts p cross join lateral (values ('AUT', p.aut_frame), ('DEM', p.dem_frame), ('WEST', p.west_frame))
            as f(frame_domain, frame_subframe)
          where post_year between 2020 and 2025 and {HAS_TEXT})
        where frame_subframe not in ('No Category', 'Invalid label')""",
    ),
    "eligible": (
        ("applications",),
        "select * from applications where source_country is not null and account_type is not null",
    ),
    "strata": (
        ("eligible",),
        """select source_country, account_type, frame_domain, count(*) as available,
          row_number() over (order by source_country, account_type, frame_domain) as stratum_order,
          count(*) over () as stratum_count
        from eligible group by 1, 2, 3""",
    ),
    "items": (
        ("posts",),
        "select merge_key, key_occurrence, unnest(str_split(coalesce(focal, ''), ';')) as item from posts",
    ),
    "names": (
        (),
        f"""select item, {fold('item')} as label, count(*) as mentions
        from (select unnest(str_split(coalesce({FOCAL}, ''), ';')) as item from documents) group by 1, 2""",
    ),
    "map_log": (
        (),
        f"""select doc_id as seq,
          case when {_OTHER} then source else {pick(_MAP, _LABELS)} end as label,
          case when {_OTHER} then 'Outlet ' || source when doc_id % 11 = 0 then 'Undecided'
            else {pick(_MAP, _TARGETS)} end as canonical,
          case when {_OTHER} then cast(n_chars % 97 as varchar) else {pick(_MAP, _COUNTS)} end as occurrences
        from documents""",
    ),
    "actor_map": (
        ("map_log",),
        f"""select label, arg_max(canonical, seq) as canonical
        from (select {fold('label')} as label, {fold('canonical')} as canonical, seq from map_log)
        where label <> '' group by label""",
    ),
    "targets": (
        ("map_log",),
        f"""select label, canonical, cast(sum(coalesce(try_cast(occurrences as bigint), 0)) as bigint) as total
        from (select {fold('label')} as label, {fold('canonical')} as canonical, occurrences from map_log)
        where label <> '' and canonical <> '' group by 1, 2""",
    ),
    "mapped": (("names", "actor_map"), "select n.*, m.canonical from names n left join actor_map m using (label)"),
    "top": (
        ("mapped",),
        """select canonical, cast(sum(mentions) as bigint) as mentions from mapped
        where label not in ('', 'none') and canonical is not null and canonical <> 'none'
        group by 1 order by 2 desc, 1 limit 8""",
    ),
    "cleaned": (
        ("items", "mapped", "top"),
        """select i.merge_key, i.key_occurrence,
          case when m.label in ('', 'none') or m.canonical = 'none' then 'None'
            when m.canonical is null or m.canonical not in (select canonical from top) then 'Other'
            else m.canonical end as focal_component
        from items i join mapped m using (item)""",
    ),
    "rollup": (
        ("posts", "cleaned"),
        """select merge_key, key_occurrence,
          case when self and others is not null then others
            when self and has_other then 'Other' when self then own
            when known is not null then known when has_other then 'Other' else 'None' end as focal_actor
        from (
          select p.merge_key, p.key_occurrence, p.own,
            string_agg(distinct c.focal_component, ';' order by c.focal_component)
              filter (where c.focal_component not in ('Other', 'None')) as known,
            string_agg(distinct c.focal_component, ';' order by c.focal_component)
              filter (where c.focal_component not in ('Other', 'None') and c.focal_component <> coalesce(p.own, '')) as others,
            bool_or(c.focal_component = coalesce(p.own, '')) as self,
            bool_or(c.focal_component = 'Other') as has_other
          from (select merge_key, key_occurrence,
              case when category like 'China_%' then 'china' when category like 'RF_%' then 'russia' end as own
            from posts) p left join cleaned c using (merge_key, key_occurrence)
          group by 1, 2, 3)""",
    ),
    "labeled": (
        (),
        f"""select doc_id as post_id,
          case when doc_id % 10 = 3 then '' when doc_id % 10 = 7 then ' no categories ' else {frame('aut')} end as aut,
          coalesce({frame('dem')}, 'NaN') as dem, {frame('west')} as west, {FOCAL} as focal
        from documents""",
    ),
    "clean_labels": (
        ("labeled",),
        f"""select post_id, {profile('aut')} as aut, {profile('dem')} as dem, {profile('west')} as west,
          {profile('focal')} as focal from labeled""",
    ),
    "long_labels": (
        ("clean_labels",),
        """select 'aut' as "column", aut as value from clean_labels union all select 'dem', dem from clean_labels
        union all select 'west', west from clean_labels union all select 'focal', focal from clean_labels""",
    ),
    "audit_table": (
        ("labeled",),
        f"""select *, {pick('post_id', ['aut', 'AUT_LABEL', 'dem', ' west '])} as sample_from,
          coalesce(case when post_id % 4 < 2 then {frame('aut', 'post_id')}
            when post_id % 4 = 2 then {frame('dem', 'post_id')} else {frame('west', 'post_id')} end, '') as label_value,
          case when post_id % 5 = 0 then 'N' else ' y ' end as frame_ok,
          case when post_id % 3 = 0 then 'Y' else '' end as focal_ok
        from labeled""",
    ),
    "audit_rows": (
        ("audit_table",),
        " union all ".join(
            f"""select '{task}' as task, {scoring('label_value' if task != 'focal' else 'focal')} as truth,
              {scoring(f"case when post_id % 7 <> 0 then {task} else '' end")} as predicted
            from audit_table where {scope}"""
            for task, scope in (
                ("aut", "upper(trim(frame_ok)) = 'Y' and trim(sample_from) in ('aut', 'AUT_LABEL')"),
                ("dem", "upper(trim(frame_ok)) = 'Y' and trim(sample_from) in ('dem', 'DEM_LABEL')"),
                ("west", "upper(trim(frame_ok)) = 'Y' and trim(sample_from) in ('west', 'WEST_LABEL')"),
                ("focal", "upper(trim(focal_ok)) = 'Y'"),
            )
        ),
    ),
    "replies": (
        (),
        f"""select conv_id, turn, text, case n % 7 when 0 then label when 1 then '["' || label || '", "x"]'
          when 2 then 'Answer: [' || label || ', other]' when 3 then '"' || label || '"'
          when 4 then replace(upper(label), ' ', '  ') when 5 then 'No Categories.' else 'unknown' end as reply
        from (select *, {pick('n', TASK_LABELS['DEM'])} as label
          from (select *, conv_id * 10 + turn as n from conversations))""",
    ),
    "truth_labels": (
        (),
        """select doc_id as post_id, case when doc_id % 11 = 0 then 'Not Applicable'
          when quality = 1 and toxic = 0 then 'Pro' when quality = 0 and toxic = 0 then 'Neutral'
          else 'Anti' end as focal_valence from labels""",
    ),
    "training": (("eligible", "truth_labels"), "select * from eligible join truth_labels using (post_id)"),
    "rest": (
        ("eligible", "training"),
        """select e.* from eligible e anti join training t
        on e.merge_key = t.merge_key and e.key_occurrence = t.key_occurrence and e.frame_domain = t.frame_domain""",
    ),
    "prepared": (
        ("training",),
        """select *, merge_key || ':' || key_occurrence as group_id,
          'source_country=' || source_country || ' account_type=' || account_type || ' frame=' || frame_domain
          || ' subframe=' || frame_subframe || ' focal_actor=' || focal_actor || ' text=' || text as model_text
        from training""",
    ),
    "target_rows": (("prepared",), "select * from prepared where focal_valence not in ('Not Applicable')"),
    "group_labels": (
        ("target_rows",),
        """select group_id, arg_min(focal_valence, (-n, focal_valence)) as label
        from (select group_id, focal_valence, count(*) as n from target_rows group by 1, 2) group by 1""",
    ),
    "folds": (
        ("group_labels",),
        f"""select group_id, label, cast((row_number() over (partition by label
          order by {digest('group_id')}, group_id) - 1) % 5 + 1 as integer) as fold from group_labels""",
    ),
    "fold_predictions": (
        ("truth_labels",),
        f"""select 'focal_valence' as target, m.model, post_id % 5 as fold, focal_valence as y_true,
          case when m.model = 'm0' then 'Pro' else {pick('n_chars', ['Pro', 'Anti', 'Neutral'])} end as y_pred
        from truth_labels t join documents d on d.doc_id = t.post_id
        cross join (values ('m0'), ('m1')) as m(model)""",
    ),
    "class_scores": (
        ("fold_predictions",),
        """select *, case when predicted > 0 then hits / predicted::double else 0 end as precision,
          case when support > 0 then hits / support::double else 0 end as recall
        from (
          select r.target, r.model, r.fold, c.label, count(*) filter (where y_true = c.label) as support,
            count(*) filter (where y_pred = c.label) as predicted,
            count(*) filter (where y_true = c.label and y_pred = c.label) as hits
          from fold_predictions r join (
            select distinct target, model, fold, y_true as label from fold_predictions
            union select distinct target, model, fold, y_pred from fold_predictions) c
            using (target, model, fold)
          group by 1, 2, 3, 4)""",
    ),
    "scored": (
        ("class_scores",),
        """select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1
        from class_scores""",
    ),
    "macro": (
        ("scored",),
        """select target, model, fold, 'all' as label, cast(support as bigint) as support, metric, value
        from (select target, model, fold, sum(support) as support, sum(hits) / sum(support)::double as accuracy,
            avg(precision) as precision_macro, avg(recall) as recall_macro, avg(f1) as f1_macro
          from scored group by 1, 2, 3)
        unpivot (value for metric in (accuracy, precision_macro, recall_macro, f1_macro))""",
    ),
    "summary": (
        ("macro",),
        """select target, model, metric, avg(value) as mean, stddev_samp(value) as std from macro group by 1, 2, 3""",
    ),
}


def query(body: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """`body` with the tables it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in TABLES[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    tables = {name: TABLES[name][1] for name in order} | (extra or {})
    if not tables:
        return body
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in tables.items()) + "\n" + body
