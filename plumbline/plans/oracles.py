"""The same results in SQL, for an engine that shares no code with this one."""

from __future__ import annotations

from plumbline.plans.catalogue import ERAS, values_sql

BINS = range(1, 11)


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"


def pc(p: str, y: str) -> str:
    return f"coalesce(covar_pop({p}, {y}) / nullif(stddev_pop({p}) * stddev_pop({y}), 0), 0)"


BASE = """
r as (select l_partkey as item, l_suppkey as rater, cast(ceil(l_quantity / 5) as int) as score from lineitem),
ls as (select item, count(*) as n, avg(score) as label, coalesce(stddev_samp(score), 0) as sd from r group by item),
i as (select ls.*, sd / sqrt(n) as se, p_brand as brand, p_type as type, item % 5 as fold from ls join part on p_partkey = item),
ro as (select i.*, k, case when fold = k then 'test' when fold = (k + 1) % 5 then 'val' else 'train' end as role from i, range(5) t(k)),
gb as (select k, brand, avg(label) as p from ro where role = 'train' group by k, brand),
gt as (select k, type, avg(label) as p from ro where role = 'train' group by k, type),
gm as (select k, avg(label) as p from ro where role = 'train' group by k),
s as (select k, item, round(label, 9) as y, brand, type, round(p, 9) as p from ro join gb using (k, brand) where role = 'test'),
st as (select k, item, round(label, 9) as y, brand, type, round(p, 9) as p from ro join gt using (k, type) where role = 'test'),
sm as (select k, item, round(label, 9) as y, brand, type, round(p, 9) as p from ro join gm using (k) where role = 'test')"""


def ranked(source: str, by: str) -> str:
    part = f"partition by {by}"
    avg = lambda v: f"rank() over ({part} order by {v}) - 1 + (count(*) over ({part}, {v}) - 1) / 2.0"
    return f"(select *, {avg('p')} as rp, {avg('y')} as ry from {source})"


POINTS = f"count(*) as n, {r6(pc('p', 'y'), 'PC')}, {r6(pc('rp', 'ry'), 'SROCC')}, {r6('avg(abs(p - y))', 'MAE')}, {r6('sqrt(avg((p - y) * (p - y)))', 'RMSE')}"
HIST = ", ".join(f"count(*) filter (where score = {k}) as c{k}" for k in BINS)
DIST = f"""
h as (select item, unnest([{', '.join(map(str, BINS))}]) as bin, unnest([{', '.join(f'c{k}' for k in BINS)}]) as c from (select item, {HIST} from r group by item)),
hb as (select h.*, brand, type from h join i using (item)),
a as (select *, c / sum(c) over (partition by item) as a from hb),
b as (select brand, bin, sum(c) as t from hb group by brand, bin),
bp as (select brand, bin, t / sum(t) over (partition by brand) as p from b),
d as (select a.*, bp.p from a join bp using (brand, bin)),
m as (select item, any_value(type) as type, max(abs(p - a)) as "Chebyshev", sqrt(sum((abs(p - a) / (p + a + 1e-12)) ** 2)) as "Clark", sum(abs(p - a) / (p + a + 1e-12)) as "Canberra",
  sum(a * ln((a + 1e-12) / (p + 1e-12))) as "KL", sum(p * a) / (sqrt(sum(p * p)) * sqrt(sum(a * a)) + 1e-12) as "Cosine", sum(least(p, a)) as "Intersection" from d group by item)"""
SIX = ", ".join(r6(f'avg("{k}")', f'"{k}"') for k in ("Chebyshev", "Clark", "Canberra", "KL", "Cosine", "Intersection"))
WEIGHTS = """
cw as (select least(9, greatest(0, round_even(label, 0) - 1))::int as bin, count(*) as n from i group by 1),
w as (select bin, n, (select sum(n) from cw) / n as raw from cw),
ww as (select bin, n, raw / (select avg(raw) from w) as weight from w)"""


def rater(passes: int) -> str:
    out = ["pr as (select item, rater, sum(score) as s, count(*) as c from r group by item, rater)"]
    for k in range(passes):
        minus = "" if k == 0 else " - c * offs"
        join = "" if k == 0 else f" join o{k - 1} using (rater)"
        out.append(f"q{k} as (select item, sum(s{minus}) / sum(c) as quality from pr{join} group by item)")
        out.append(f"x{k} as (select rater, sum(s - c * quality) / sum(c) as raw, sum(c) as n from pr join q{k} using (item) group by rater)")
        out.append(f"o{k} as (select rater, n, raw - (select sum(raw * n) / sum(n) from x{k}) as offs from x{k})")
    return ", ".join(out)


DOCS = """docs as (select doc_id, lang, cast(n_chars as double) as y, cast(len(regexp_replace(text, '[^ ]+', '', 'g')) as double) as a, cast(len(regexp_replace(text, '[^.]+', '', 'g')) as double) as b2,
  row_number() over (order by doc_id) - 1 as pos, row_number() over (partition by lang order by doc_id) - 1 as gat, count(*) over () as n, count(*) over (partition by lang) as gn from documents)"""


def drawn(seed: int, resamples: int) -> str:
    return f"dr as (select b, ('0x' || substr(md5('{seed}|' || b || '|' || k), 1, 12))::bigint % (select max(n) from docs) as pos from range({resamples}) t(b), range((select max(n) from docs)) u(k))"


def group_drawn(seed: int) -> str:
    return f"""z as (select lang, gn, unnest(range(10000)) as b from (select distinct lang, gn from docs)),
zz as (select lang, gn, b, unnest(range(gn)) as k from z),
dr as (select lang, b, ('0x' || substr(md5('{seed}|' || lang || '|' || b || '|' || k), 1, 12))::bigint % gn as gat from zz),
g as (select lang as "group", b, {pc('a', 'y')} as "PC", avg(abs(a - y)) as "MAE", sqrt(avg((a - y) * (a - y))) as "RMSE", max(a) > min(a) as pv, max(y) > min(y) as yv from dr join docs using (lang, gat) group by lang, b)"""


TABLE = f"""t as (select '=' || lang as grp, a, y, gat, gn from docs union all select 'all', a, y, pos, n from docs),
z as (select grp, gn, unnest(range(10000)) as b from (select distinct grp, gn from t)),
zz as (select grp, gn, b, unnest(range(gn)) as k from z),
dr as (select grp, b, ('0x' || substr(md5('23|' || grp || '|' || b || '|' || k), 1, 12))::bigint % gn as gat from zz),
g as (select grp, b, {pc('a', 'y')} as "PC", avg(abs(a - y)) as "MAE", sqrt(avg((a - y) * (a - y))) as "RMSE", max(a) > min(a) as pv, max(y) > min(y) as yv from dr join t using (grp, gat) group by grp, b),
m as (select grp, count(*) as n, {pc('a', 'y')} as "PC", avg(abs(a - y)) as "MAE", sqrt(avg((a - y) * (a - y))) as "RMSE" from t group by grp)"""
# ridge by elimination: the matrix is positive definite, so no pivoting
RIDGE = """
z as (select item, train, feature, (value - mean) / sd as zv, label from l join sc using (feature)),
mid as (select avg(label) as centre from (select distinct item, label from z where train)),
g as (select a.feature as i, b.feature as j, sum(a.zv * b.zv) + any_value(case when a.feature = b.feature then 10.0 else 0.0 end) as v from z a join z b using (item) where a.train and b.train group by a.feature, b.feature),
rhs as (select feature as i, sum(zv * (label - centre)) as v from z, mid where train group by feature),
mat as (select list(r || [v] order by i) as m from (select i, list(v order by j) as r from g group by i) join rhs using (i)),
steps as (select 1 as k, m from mat union all
  select k + 1, list_transform(list_zip(m, range(1, 65)), lambda ri: list_transform(list_zip(ri[1], m[k]), lambda xp: case when ri[2] = k then xp[1] / m[k][k] else xp[1] - ri[1][k] * xp[2] / m[k][k] end)) from steps where k <= 64),
b as (select unnest(range(64)) as feature, unnest(list_transform(m, lambda r: r[65])) as coefficient from steps where k = 65)"""


def q(x: str, at: float) -> str:
    return f"quantile_cont({x}, {at})"


RUNS = f"""
runs as (select 'mean-baseline' as method, 'baseline' as era, k, {POINTS} from {ranked('sm', 'k')} group by k
  union all by name select 'group-brand' as method, 'classical' as era, k, {POINTS} from {ranked('s', 'k')} group by k
  union all by name select 'group-type' as method, 'classical' as era, k, {POINTS} from {ranked('st', 'k')} group by k)"""
# fold statistics are taken before rounding
RAW = RUNS.replace("round(", "(").replace(", 6) + 0.0", ")")
SUMMARY = ", ".join(f'{r6(f"avg(\"{m}\")", m + "_mean")}, {r6(f"stddev_pop(\"{m}\")", m + "_sd")}' for m in ("PC", "SROCC", "MAE", "RMSE"))
GROUPS = f"count(*) as n, {r6(pc('p', 'y'), 'PC')}, {r6('avg(abs(p - y))', 'MAE')}, {r6('sqrt(avg((p - y) * (p - y)))', 'RMSE')}"
RATES = f"""
rates as (select method, batch, epoch, lr * case
  when schedule = 'cosine' then 0.5 * (1 + cos(pi() * epoch / epochs))
  when starts_with(schedule, 'step') then pow(0.1, floor(epoch / greatest(1, floor(epochs / 4))))
  when epoch < greatest(1, floor(epochs / 10)) then (epoch + 1) / greatest(1, floor(epochs / 10))
  when schedule = 'warmup_cosine' then 0.5 * (1 + cos(pi() * least(1, (epoch - greatest(1, floor(epochs / 10))) / greatest(1, epochs - greatest(1, floor(epochs / 10))))))
  else greatest(0, (epochs - epoch) / greatest(1, epochs - greatest(1, floor(epochs / 10)))) end as lr
  from (select *, unnest(range(epochs)) as epoch from {values_sql()} where schedule is not null))"""
KEYS = list(range(19))


def faces(n: int) -> str:
    return f"""
raw as (select vec_id, unnest(range(32)) as i, embedding from embeddings),
pt as (select vec_id, i, embedding[2 * i + 1]::double as x, embedding[2 * i + 2]::double as y from raw),
eye as (select vec_id, avg(x) as mx, avg(y) as my, sqrt((avg(x) filter (where i in (1, 2, 3)) - avg(x) filter (where i in (5, 6, 7))) ** 2 + (avg(y) filter (where i in (1, 2, 3)) - avg(y) filter (where i in (5, 6, 7))) ** 2) as eyes from pt group by vec_id),
np as (select vec_id, i, (x - mx) / eyes as x, (y - my) / eyes as y from pt join eye using (vec_id)),
kp as (select vec_id, list_position({KEYS[:n]}, i) - 1 as k, x, y from np where i in ({', '.join(map(str, KEYS[:n]))})),
pd as (select a.vec_id, row_number() over (partition by a.vec_id order by a.k, b.k) - 1 as pair, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as distance from kp a join kp b on a.vec_id = b.vec_id and a.k < b.k)"""


LONG = """
l as (select vec_id as item, vec_id % 5 <> 0 as train, cast(label as double) as label, unnest(range(64)) as feature, unnest(embedding)::double as value from embeddings),
sc as (select feature, avg(value) as mean, case when stddev_pop(value) < 1e-8 then 1 else stddev_pop(value) end as sd from l where train group by feature)"""


def _with(*parts: str) -> str:
    return "with " + ", ".join(p.strip() for p in parts) + " "


ORACLES = {
    "label_stats": _with(BASE) + f"select item, n, {r6('label', 'label')}, {r6('sd', 'sd')}, {r6('sd / sqrt(n)', 'se')} from ls",
    "standard_error": _with(BASE) + f"select item, {r6('sd / sqrt(n)', 'se')} from ls",
    "histogram_label_stats": _with(BASE) + f"select item, n, {r6('label', 'label')}, {r6('sd', 'sd')} from ls",
    "label_histogram": _with(BASE) + f"select item, concat_ws(',', {', '.join(f'c{k}' for k in BINS)}) as counts from (select item, {HIST} from r group by item)",
    "histogram_normalised": _with(BASE, DIST) + f"select item, (bin - 1)::int as bin, {r6('a', 'share')} from a",
    "cv_roles": _with(BASE) + "select k::int as k, item, role from ro",
    "split_sizes": _with(BASE) + "select k::int as k, role, count(*) as n from ro group by k, role",
    "group_integrity": _with(BASE) + "select brand, count(distinct role) as n_roles from ro where k = 0 group by brand having count(distinct role) > 1",
    "attribute_codes": _with(BASE)
    + "select key, (case when c < 32 then c else 0 end)::int as code from (select key, row_number() over (order by first) - 1 as c from (select concat_ws('/', type, brand) as key, min(item) as first from ro where k = 0 and role = 'train' group by 1))",
    "permuted_labels": _with(BASE)
    + f"select a.item, {r6('a.label', 'label')}, {r6('b.label', 'shuffled')} from (select item, label, row_number() over (order by item) as pos from i) a join (select label, row_number() over (order by md5('7|' || item), item) as pos from i) b using (pos)",
    "union_of_folds": _with(BASE) + "select k::int as k, count(*) as n, count(distinct item) as n_distinct from s group by k",
    "point_metrics_cv": _with(BASE) + f"select k::int as k, {POINTS} from {ranked('s', 'k')} group by k",
    "mean_baseline_cv": _with(BASE) + f"select k::int as k, count(*) as n, {r6(pc('p', 'y'), 'PC')}, {r6('avg(abs(p - y))', 'MAE')}, {r6('sqrt(avg((p - y) * (p - y)))', 'RMSE')} from sm group by k",
    "constant_prediction_zero_corr": _with(BASE) + f"select type, {pc('5.0::double', 'label')} as \"PC\" from i group by type",
    "spearman_by_type": _with(BASE) + f"select type, {r6(pc('rp', 'ry'), 'SROCC')} from {ranked('s', 'type')} group by type",
    "average_rank": _with(BASE) + "select item, rank() over (order by v) - 1 + (count(*) over (partition by v) - 1) / 2.0 as rank from (select item, round(label, 9) as v from i)",
    "clipped_scores": _with(BASE) + f"select item, {r6('greatest(1.0, least(10.0, p * 2 - 5))', 'score')} from s",
    "distribution_metrics": _with(BASE, DIST) + f"select count(*) as n, {SIX} from m",
    "distribution_by_group": _with(BASE, DIST) + f"select type, count(*) as n, {SIX} from m group by type",
    "expected_scores": _with(BASE, DIST) + f"select item, {r6('sum(p * bin)', 'expected')}, {r6('-sum(c * ln(p + 1e-12))', 'nll')} from d group by item",
    "softmax_embeddings": "with l as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings), e as (select *, exp(v - max(v) over (partition by vec_id)) as e from l), "
    f"s as (select *, e / sum(e) over (partition by vec_id) as s from e) select vec_id, {r6('max(s)', 'top')}, {r6('sum(s * (i + 1))', 'expected')} from s group by vec_id",
    "losses": _with(BASE)
    + f"select k::int as k, {r6('avg(case when abs(p - y) < 1 then 0.5 * (p - y) * (p - y) else abs(p - y) - 0.5 end)', 'smooth_l1')}, {r6('avg(abs(p - y))', 'l1')}, {r6('avg((p - y) * (p - y))', 'mse')}, {r6('avg(exp(-0.5) * (p - y) * (p - y) + 0.5)', 'heteroscedastic')} from s group by k",
    "weighted_cross_entropy": _with(BASE, DIST, WEIGHTS)
    + f"select {r6('sum(-weight * ln(p + 1e-12)) / sum(weight)', 'cross_entropy')} from (select d.p, ww.weight from d join (select item, least(9, greatest(0, round_even(label, 0) - 1))::int as b from i) x on x.item = d.item and x.b = d.bin - 1 join ww on ww.bin = x.b)",
    "class_weights": _with(BASE, WEIGHTS) + f"select bin, n, {r6('weight', 'weight')} from ww",
    "precision_weights": _with(BASE)
    + f", f as (select quantile_cont(se, 0.5) as m from i), w as (select item, 1 / (sd * sd * (n - 1) / n / n + m * m) as raw from i, f) select item, {r6('raw / (select avg(raw) from w)', 'weight')} from w",
    "rater_offsets": _with(BASE, rater(3)) + f"select rater, n::bigint as n, {r6('offs', '\"offset\"')} from o2",
    "rater_adjusted_quality": _with(BASE, rater(3)) + f"select item, {r6('sum(s - c * offs) / sum(c)', 'quality')} from pr join o2 using (rater) group by item",
    "margin_ranking_pairs": _with(BASE)
    + f"select a.item // 32 as batch, count(*) as pairs, {r6('avg(greatest(0, -sign(a.y - b.y) * (a.p - b.p) + 0.1))', 'loss')} from s a join s b on a.item // 32 = b.item // 32 and a.item < b.item and abs(a.y - b.y) > 0.1 group by 1",
    "subgroup_metrics": _with(BASE) + f'select type as "group", {GROUPS} from s group by type having count(*) >= 3',
    "subgroup_grouping_sets": _with(BASE) + f"select coalesce(type, 'all') as \"group\", {GROUPS} from s group by grouping sets ((type), ())",
    "subgroup_dimensions": _with(BASE)
    + f"select dimension, value, count(*) as n, {r6(pc('p', 'y'), 'PC')}, {r6('avg(abs(p - y))', 'MAE')} from (select p, y, 'type' as dimension, type as value from s union all select p, y, 'brand', brand from s) group by all",
    "subgroup_extremes": _with(BASE)
    + f", g as (select type as g, {GROUPS} from s group by type), l as (select g, unnest(['PC', 'MAE', 'RMSE']) as metric, unnest([-\"PC\", \"MAE\", \"RMSE\"]) as v from g) select metric, arg_min(g, row(v, g)) as best, arg_max(g, row(v, g)) as worst from l group by metric",
    "bootstrap_ci": _with(DOCS, drawn(11, 2000)) + f", c as (select b, {pc('a', 'y')} as p from dr join docs using (pos) group by b) select {r6(q('p', 0.025), 'lo')}, {r6(q('p', 0.975), 'hi')} from c",
    "paired_bootstrap": _with(DOCS, drawn(13, 2000))
    + f", c as (select b, {pc('a', 'y')} - {pc('b2', 'y')} as d from dr join docs using (pos) group by b), o as (select {pc('a', 'y')} - {pc('b2', 'y')} as x from docs) select {r6('(select x from o)', 'difference')}, {r6(q('d', 0.025), 'lo')}, {r6(q('d', 0.975), 'hi')}, "
    + r6("least(1.0, 2 * least(avg(case when d <= 0 then 1.0 else 0.0 end), avg(case when d >= 0 then 1.0 else 0.0 end)))", "p")
    + " from c",
    "subgroup_bootstrap": _with(DOCS, group_drawn(17))
    + 'select "group", '
    + ", ".join(f'{r6(q(chr(34) + m + chr(34), 0.025), m + "_lo")}, {r6(q(chr(34) + m + chr(34), 0.975), m + "_hi")}' for m in ("PC", "MAE", "RMSE"))
    + ' from g where pv and yv group by "group"',
    "subgroup_gap": _with(DOCS, group_drawn(19))
    + f", d as (select x.\"PC\" - y.\"PC\" as d from g x join g y using (b) where x.\"group\" = 'en' and y.\"group\" = 'de' and x.yv and y.yv) select {r6(q('d', 0.025), 'lo')}, {r6(q('d', 0.975), 'hi')}, {q('d', 0.025)} > 0 or {q('d', 0.975)} < 0 as excludes_zero from d",
    "subgroup_table": _with(DOCS, TABLE)
    + ", iv as (select grp, "
    + ", ".join(f'{q(chr(34) + m + chr(34), at)} as {m}_{e}' for m in ("PC", "MAE", "RMSE") for e, at in (("lo", 0.025), ("hi", 0.975)))
    + " from g where pv and yv group by grp) select case when grp = 'all' then grp else substr(grp, 2) end as \"group\", n, "
    + ", ".join(r6(f'"{m}{e}"', f'"{m}{e}"') for m in ("PC", "MAE", "RMSE") for e in ("", "_lo", "_hi"))
    + ", (row_number() over (order by grp = 'all', \"PC\" desc, grp desc))::int as place from m left join iv using (grp)",
    "counts_from_shares": _with(BASE, DIST) + f"select item, (bin - 1)::int as bin, {r6('a * n', 'count')} from a join ls using (item)",
    "log_softmax_embeddings": "with l as (select vec_id, unnest(embedding)::double as v from embeddings), e as (select *, v - max(v) over (partition by vec_id) as d from l), "
    f"s as (select vec_id, d - ln(sum(exp(d)) over (partition by vec_id)) as s from e) select vec_id, {r6('max(s)', 'top')}, {r6('min(s)', 'least')} from s group by vec_id",
    "union_of_splits": _with(BASE) + "select k::int as k, role, count(*) as n from ro group by k, role",
    "attributes_of_test_items": _with(BASE)
    + ", c as (select key, row_number() over (order by first) - 1 as c from (select concat_ws('/', type, brand) as key, min(item) as first from ro where k = 0 and role = 'train' group by 1)) "
    "select item, coalesce(case when c < 32 then c else 0 end, 0)::int as code from ro left join c on key = concat_ws('/', type, brand) where k = 0 and role = 'test'",
    "fold_count": _with(BASE, RAW) + "select max(n)::bigint as folds from (select method, count(*) as n from runs group by method)",
    "multinomial_likelihood": _with(BASE, DIST)
    + f"select type, {r6('sum(nll) / count(*) / avg(n)', 'likelihood')} from (select item, -sum(c * ln(p + 1e-12)) as nll from d group by item) join i using (item) group by type",
    "best_by_metric": _with(BASE, RUNS)
    + """, l as (select method, unnest(['PC', 'SROCC', 'MAE', 'RMSE']) as metric, unnest([false, false, true, true]) as lower_is_better, unnest([round("PC", 6), round("SROCC", 6), round("MAE", 6), round("RMSE", 6)]) as value from runs where k = 0)
 select metric, lower_is_better, method, value from l qualify row_number() over (partition by metric order by case when lower_is_better then value else -value end, method) = 1""",
    "ridge_prediction": _with(LONG, RIDGE).replace("with ", "with recursive ", 1) + f"select item, {r6('any_value(centre) + sum(zv * coefficient)', 'p')} from z join b using (feature), mid where not train group by item",
    "fold_summary": _with(BASE, RAW) + f"select method, count(*) as folds, {SUMMARY} from runs group by method",
    "leaderboard_ranked": _with(BASE, RUNS)
    + f"select method, era, \"PC\", \"SROCC\", \"MAE\", \"RMSE\", (list_position({list(ERAS)!r}, era) - 1)::int as era_order, (row_number() over (partition by era order by \"PC\" desc nulls last, method))::int as rank from runs where k = 0",
    "chart_data": _with(BASE, RAW)
    + f", c as (select method, avg(\"PC\") as m, stddev_pop(\"PC\") as sd from runs where method <> 'group-type' group by method) select r0.method, {r6('coalesce(m, \"PC\")', 'PC')}, {r6('coalesce(sd, 0)', 'sd')}, case when m is null then 'holdout' else 'cv' end as protocol from runs r0 left join c using (method) where k = 0",
    "equal_width_histogram": _with(BASE)
    + ", v as (select round(label, 9) as x from i), e as (select min(x) as lo, max(x) as hi from v) select least(floor((x - lo) / ((hi - lo) / 40)), 39)::int as bin, count(*) as n from v, e group by 1",
    "value_counts": _with(BASE) + "select type, count(*) as n, min(n) as least, max(n) as most from i group by type",
    "method_catalogue": _with(BASE, RUNS)
    + f"select m.method, m.era, (list_position({list(ERAS)!r}, m.era) - 1)::int as era_order, schedule is not null as trainable, \"PC\" from {values_sql()} left join (select method, \"PC\" from runs where k = 0) using (method)",
    "setup_table": _with(BASE)
    + f"select method, era, source, optimiser, lr::double as lr, decay::double as decay, batch, epochs, backbone, schedule, ceil((select count(*) from ro where k = 0 and role = 'train') / batch)::int as steps from {values_sql()} where source is not null",
    "lr_schedules": _with(BASE, RATES)
    + "select method, epoch::int as epoch, round(lr, 9)::double + 0.0 as lr, (epoch * ceil((select count(*) from ro where k = 0 and role = 'train') / batch))::int as first_step from rates",
    "early_stopping": """
with recursive l as (select run, epoch, val, row_number() over (partition by run order by epoch) as i from
  (select o_orderpriority as run, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 as epoch, round(avg(o_totalprice), 2) as val from orders group by 1, 2)),
s as (select run, 0::bigint as i, 'infinity'::double as best, -1::bigint as best_epoch, 0 as bad, -1::bigint as stop from l group by run
  union all
  select s.run, l.i, case when stop < 0 and val < best - 1e-4 then val else best end, case when stop < 0 and val < best - 1e-4 then epoch else best_epoch end,
    case when val < best - 1e-4 then 0 else bad + 1 end, case when stop >= 0 then stop when val >= best - 1e-4 and bad + 1 >= 5 then epoch else -1 end
  from s join l on l.run = s.run and l.i = s.i + 1)
select run, best_epoch::int as best_epoch, round(best, 6) as best, stop::int as stopped_at from s qualify row_number() over (partition by run order by i desc) = 1
""",    "ensemble_rank_average": _with(BASE)
    + f""", e as (select item, round(p, 6) as v, 'a' as m from s union all select item, round(p, 6), 'b' from st),
 k as (select item, avg(rr) as mean_rank from (select item, row_number() over (partition by m order by v, item) - 1 as rr from e) group by item),
 n as (select *, (row_number() over (order by mean_rank, item) - 0.5) / count(*) over () * ((select count(*) from i) - 1) as pos from k),
 lb as (select label, row_number() over (order by label) - 1 as j from i)
 select item, {r6('mean_rank', 'mean_rank')}, {r6('x.label + (pos - floor(pos)) * (z.label - x.label)', 'p')} from n join lb x on x.j = floor(pos) join lb z on z.j = least(floor(pos) + 1, (select count(*) from i) - 1)""",
    "test_time_mean": _with(BASE) + f"select item, {r6('avg(p)', 'score')} from (select item, p from s union all select item, p from st) group by item",
    "pairwise_distances": _with(faces(19)) + f"select vec_id, pair::int as pair, {r6('distance', 'distance')} from pd",
    "symmetry_features": _with(faces(19))
    + f", mid as (select vec_id, avg(x) as m from np where i in (27, 28, 29, 30) group by vec_id), pr as (select unnest([0, 4, 19, 1, 2, 3, 31]) as i, unnest([16, 12, 24, 15, 14, 13, 25]) as j, unnest(range(7)) as pair) select a.vec_id, pair::int as pair, {r6('abs(abs(a.x - m) - abs(b.x - m))', 'asymmetry')} from pr join np a on a.i = pr.i join np b on b.i = pr.j and a.vec_id = b.vec_id join mid on mid.vec_id = a.vec_id",
    "proportion_features": _with(faces(19))
    + f"select a.vec_id, (a.pair * 12 + b.pair // 14)::int as ratio, {r6('ln(a.distance / (b.distance + 1e-8) + 1e-8)', 'log_value')} from pd a join pd b using (vec_id) where b.pair % 14 = 0 and b.pair // 14 < 12",
    "standardised_features": _with(LONG) + f"select item, feature::int as feature, {r6('(value - mean) / sd', 'z')} from l join sc using (feature) where not train",
    "univariate_selection": _with(LONG)
    + f", c as (select feature, round({pc('value', 'label')}, 9) as r from l where train group by feature) select feature::int as feature, {r6('r', 'r')}, (row_number() over (order by abs(r) desc, feature))::int as rank from c order by rank limit 20",
    "knn_regression": "with e as (select vec_id as item, embedding::double[] as f, cast(label as double) as label from embeddings), "
    "d as (select a.item, b.item as t, b.label, round(sqrt(list_sum(list_transform(range(1, 65), lambda j: (a.f[j] - b.f[j]) * (a.f[j] - b.f[j])))), 9) as d from e a join e b on a.item % 5 = 0 and b.item % 5 <> 0), "
    "n as (select * from (select *, row_number() over (partition by item order by d, t) as rn from d) where rn <= 15) "
    f"select item, {r6('case when min(d) = 0 then avg(label) filter (where d = 0) else sum(label / nullif(d, 0)) / sum(1 / nullif(d, 0)) end', 'p')} from n group by item",
}
