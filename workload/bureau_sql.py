"""Independent SQL for the end-to-end plans over the bureau-shaped views.

Written as joins and subqueries over whole tables, without any of the rewrites the Spark plans
use (no exploded as-of matching, no merged aggregations).
"""

from __future__ import annotations

MIN_ACTIVE = 3
START = "DATE '2015-02-01'"
CONTEXT = "DATE '2015-01-01'"

LETTERS = """letters(letter, code) AS (VALUES ('A','NL'),('B','NS'),('C','PE'),('E','NB'),('G','QC'),('H','QC'),('J','QC'),
  ('K','ON'),('L','ON'),('M','ON'),('N','ON'),('P','ON'),('R','MB'),('S','SK'),('T','AB'),('V','BC'),('X','NT'),('Y','YT'))"""


def day(text: str, chars: int = 8) -> str:
    """Compact text to a date, NULL when it is not one."""
    padded = f"substr({text}, 1, 8)" if chars == 8 else f"concat(substr({text}, 1, 6), '01')"
    return f"CAST(try_strptime({padded}, '%Y%m%d') AS DATE)"


def months(date: str, n: int) -> str:
    sign = "+" if n >= 0 else "-"
    return f"CAST({date} {sign} INTERVAL {abs(n)} MONTH AS DATE)"


def floor_month(date: str) -> str:
    return f"CAST(date_trunc('month', {date}) AS DATE)"


IN_AREA = "regexp_matches({0}, '^(T9H|T9J|T9K)$')"


def consumer() -> str:
    """… crc: the consumer panel."""
    moved = (
        "w.tu_consumer_id IS NOT NULL AND NOT " + IN_AREA.format("a.fsa")
        + " AND a.run_date BETWEEN DATE '2016-05-01' AND DATE '2016-11-01'"
    )
    return f"""
{LETTERS},
crc_typed AS (
  SELECT b.tu_consumer_id, {day('b.run_date', 6)} AS run_date, b.fsa, b.encrypted_ldu, b.go91,
    CASE WHEN go30 > 120 THEN CAST(go30 AS DOUBLE) / 12 WHEN go30 > 0 THEN CAST(go30 AS DOUBLE) END AS age,
    CASE WHEN l.code IS NOT NULL THEN l.code
      WHEN regexp_matches(go90, '(ON|QC|NS|NB|MB|BC|PE|SK|AB|NL|NT|YT|NU)') THEN go90 END AS prov,
    nullif(as115, 0) AS as115, CASE WHEN cvsc100 IN (0, -8) THEN NULL ELSE cvsc100 END AS cvsc100
  FROM {{bureau_consumer}} AS b LEFT JOIN letters AS l ON l.letter = substr(b.fsa, 1, 1)),
crc_alive AS (
  SELECT * FROM crc_typed WHERE go91 = 'N' AND tu_consumer_id IN (SELECT tu_consumer_id FROM crc_typed WHERE regexp_matches(prov, 'AB|SK'))),
crc_cohort AS (SELECT * FROM crc_alive WHERE run_date = DATE '2016-05-01' AND {IN_AREA.format('fsa')}),
crc_moved AS (
  SELECT a.tu_consumer_id, a.run_date, a.fsa AS fsa_reported, a.encrypted_ldu AS encrypted_ldu_reported, a.age, a.prov,
    a.as115, a.cvsc100, CAST(w.tu_consumer_id IS NOT NULL AS INT) AS treated_ind,
    CASE WHEN {moved} THEN w.fsa ELSE a.fsa END AS fsa,
    CASE WHEN {moved} THEN w.encrypted_ldu ELSE a.encrypted_ldu END AS encrypted_ldu
  FROM crc_alive AS a LEFT JOIN crc_cohort AS w ON w.tu_consumer_id = a.tu_consumer_id),
geo AS (SELECT substr(pstlcode, 1, 3) AS fsa, substr(pstlcode, 5) AS ldu, province, latitude, longitude FROM {{bureau_geo}} AS g),
geo_near AS (
  SELECT u.fsa, u.ldu, min(111.045 * degrees(acos(least(CAST(1 AS DOUBLE),
      cos(radians(u.latitude)) * cos(radians(s.latitude)) * cos(radians(u.longitude - s.longitude))
      + sin(radians(u.latitude)) * sin(radians(s.latitude)))))) AS distance_min
  FROM geo AS u CROSS JOIN (SELECT * FROM geo WHERE {IN_AREA.format('fsa')}) AS s
  WHERE u.province IN ('Alberta', 'Saskatchewan') GROUP BY u.fsa, u.ldu),
codes AS (
  SELECT DISTINCT g.fsa, g.ldu, n.distance_min, CAST(d.ldu IS NOT NULL AS INT) AS fm_damage FROM geo AS g
  LEFT JOIN geo_near AS n ON n.fsa = g.fsa AND n.ldu = g.ldu LEFT JOIN {{bureau_damaged}} AS d ON d.fsa = g.fsa AND d.ldu = g.ldu),
crc AS (
  SELECT m.*,
    CASE WHEN as115 IS NULL OR as115 <= 0 THEN 'NA' WHEN as115 < 600 THEN 'subprime' WHEN as115 < 700 THEN 'near prime'
      WHEN as115 < 780 THEN 'prime' WHEN as115 < 830 THEN 'prime plus' ELSE 'super prime' END AS as115_tier,
    CASE WHEN cvsc100 IS NULL OR cvsc100 < 300 THEN 'NA' WHEN cvsc100 < 640 THEN 'subprime' WHEN cvsc100 < 720 THEN 'near prime'
      WHEN cvsc100 < 760 THEN 'prime' WHEN cvsc100 < 800 THEN 'prime plus' ELSE 'super prime' END AS cvsc100_tier,
    c.fm_damage, c.distance_min
  FROM crc_moved AS m JOIN (SELECT encrypted_ldu, ldu FROM {{bureau_mapping}} AS k WHERE n_repeat < 2) AS k ON k.encrypted_ldu = m.encrypted_ldu
  JOIN codes AS c ON c.fsa = m.fsa AND c.ldu = k.ldu)"""


def tenure() -> str:
    """… tenure: ownership and stay per consumer-month (monthly era from 2016 in this study)."""
    def bucket(date: str, opened: bool) -> str:
        late = floor_month(months(date, 1)) if opened else floor_month(date)
        early = f"CAST(date_trunc('quarter', {date}) {'+ INTERVAL 3 MONTH' if opened else ''} AS DATE)"
        return f"CASE WHEN year({date}) >= 2016 THEN {late} ELSE {early} END"

    def lived(name: str, anchor: str, active: int) -> str:
        return f"""{name} AS (SELECT DISTINCT m.tu_consumer_id, h.fsa, h.ldu FROM mrtg AS m JOIN hist AS h
  ON h.tu_consumer_id = m.tu_consumer_id AND year({anchor}) = year(h.run_date) AND month({anchor}) = month(h.run_date)
  WHERE m.active_mrtg = {active})"""

    return f"""
hist AS (SELECT tu_consumer_id, {day('run_date', 6)} AS run_date, fsa, encrypted_ldu AS ldu, mc33 FROM {{bureau_consumer}} AS b
  WHERE tu_consumer_id IN (SELECT tu_consumer_id FROM crc)),
mrtg_typed AS (SELECT tu_consumer_id, tu_trade_id, run_date, closed_indic, current_balance, {day('opened_dt', 6)} AS od, {day('closed_dt', 6)} AS cd,
  {day('last_paymt_dt', 6)} AS pd, {day('file_since_dt')} AS fd, {day('last_updated_dt')} AS ud
  FROM {{bureau_account}} AS a WHERE product_type = 'ML' AND mop NOT IN ('8', '9')),
mrtg_dated AS (SELECT *, coalesce(od, {months('pd', -18)}) AS opened, coalesce(fd, ud) AS since,
  CASE WHEN cd IS NULL AND (coalesce(closed_indic, '') = 'Y' OR coalesce(current_balance, 1) = 0) THEN pd ELSE cd END AS closed
  FROM mrtg_typed),
mrtg AS (SELECT *, CASE WHEN current_balance > 0 THEN 1 ELSE 0 END AS active_mrtg, {bucket('opened', True)} AS opened_qtr,
  {bucket('closed', False)} AS closed_qtr FROM mrtg_dated),
{lived('at_opened', months('m.opened_qtr', 12), 0)},
{lived('at_closed', months('m.closed_qtr', -12), 0)},
{lived('at_active', months('m.since', 1), 1)},
counted AS (SELECT tu_consumer_id, run_date, COUNT(tu_trade_id) AS n_all_mrtg FROM mrtg GROUP BY 1, 2),
owners AS (
  SELECT h.tu_consumer_id, h.run_date, h.fsa, h.ldu,
    CASE WHEN mc33 > 0 OR mc33 = 0 AND (o.fsa IS NOT NULL OR x.fsa IS NOT NULL OR a.fsa IS NOT NULL) THEN 1 ELSE 0 END AS homeowner_mrtg
  FROM hist AS h
  LEFT JOIN at_opened AS o ON o.tu_consumer_id = h.tu_consumer_id AND o.fsa = h.fsa AND o.ldu = h.ldu
  LEFT JOIN at_closed AS x ON x.tu_consumer_id = h.tu_consumer_id AND x.fsa = h.fsa AND x.ldu = h.ldu
  LEFT JOIN at_active AS a ON a.tu_consumer_id = h.tu_consumer_id AND a.fsa = h.fsa AND a.ldu = h.ldu
  WHERE year(h.run_date) >= 2015),
stays AS (
  SELECT n.tu_consumer_id, n.fsa, n.ldu, n.run_date,
    SUM(CASE WHEN p.run_date IS NULL THEN 0 WHEN year(p.run_date) >= 2016 THEN 1 ELSE 3 END) AS stay_dur,
    CASE WHEN min(p.run_date) = DATE '2015-01-01' THEN 1 ELSE 0 END AS stay_censored
  FROM hist AS n LEFT JOIN hist AS p ON p.tu_consumer_id = n.tu_consumer_id AND p.fsa = n.fsa AND p.ldu = n.ldu AND p.run_date < n.run_date
  WHERE year(n.run_date) >= 2016 GROUP BY 1, 2, 3, 4),
tenure AS (
  SELECT o.*, c.n_all_mrtg, CASE WHEN homeowner_mrtg = 1 AND c.n_all_mrtg IS NULL THEN 'Y' ELSE 'N' END AS mrtg_null_refine,
    CAST(s.stay_dur AS BIGINT) AS stay_dur, s.stay_censored
  FROM owners AS o LEFT JOIN counted AS c ON c.tu_consumer_id = o.tu_consumer_id AND c.run_date = o.run_date
  LEFT JOIN stays AS s ON s.tu_consumer_id = o.tu_consumer_id AND s.run_date = o.run_date)"""


FILTER = {
    "ML": "product_type = 'ML'",
    "BC": "product_type = 'BC'",
    "HELOC": "product_type = 'LC'",
    "OTHER": "acct_type <> 'M' AND product_type NOT IN ('BC', 'ML', 'UT')",
}
FACTORS = """factors(freq, per_month) AS (VALUES
  ('A', CAST(1 AS DOUBLE) / 12), ('B', CAST(2.16 AS DOUBLE)), ('D', CAST(0 AS DOUBLE)), ('E', CAST(2 AS DOUBLE)),
  ('L', CAST(1 AS DOUBLE) / 2), ('M', CAST(1 AS DOUBLE)), ('P', CAST(0 AS DOUBLE)), ('Q', CAST(1 AS DOUBLE) / 3),
  ('R', CAST(1 AS DOUBLE) / 4), ('S', CAST(1 AS DOUBLE) / 6), ('T', CAST(1 AS DOUBLE) / 3),
  ('W', CAST(4.33 AS DOUBLE)), ('Y', CAST(1 AS DOUBLE) / 12))"""

CARRIED = (
    "tu_consumer_id, tu_trade_id, joint_account_id, primary_indicator, current_balance, mop, l3, terms_dur, "
    "terms_frequency, terms_amt, months_reviewed, run_date, paymt_pat, reported_date, last_updated_date, opened_date, "
    "closed_date, file_since_date, cr_lmt, cr_lmt_woadj, chargoff_refine, terms_pay"
)
OWN = {
    "ML": "narrative_code1, narrative_code2, insurance_indicator, ml_insured",
    "BC": "narrative_code1, narrative_code2, paymt_amt, activity_period, bin",
    "HELOC": "narrative_code1, narrative_code2",
    "OTHER": "product_cat",
}


def _amounts(name: str, product: str) -> str:
    """Typed rows of one family with derived amounts, for sampled consumers."""
    named = "CASE best_amt_flag WHEN 'C' THEN credit_limit WHEN 'H' THEN high_credit_amt END"
    return f"""
{name} AS (
  SELECT a.*, substr(a.paymt_pat, 1, 12) AS pat12, tu_acct_num AS bin, {day('reported_dt')} AS reported_date,
    {day('last_updated_dt')} AS last_updated_date, {day('opened_dt')} AS opened_date, {day('closed_dt')} AS closed_date,
    {day('file_since_dt')} AS file_since_date,
    CASE WHEN best_amt_flag IS NULL THEN greatest(coalesce(credit_limit, 0), coalesce(high_credit_amt, 0), current_balance)
      WHEN CAST(current_balance AS DOUBLE) / nullif({named}, 0) < CAST(1.1 AS DOUBLE) THEN {named} ELSE current_balance END AS cr_lmt,
    {named} AS cr_lmt_woadj,
    CASE WHEN 'TC' IN (coalesce(narrative_code1, ''), coalesce(narrative_code2, '')) THEN current_balance
      WHEN 'WO' IN (coalesce(narrative_code1, ''), coalesce(narrative_code2, '')) AND coalesce(chargoff_amt, 0) = 0 THEN current_balance
      ELSE least(coalesce(chargoff_amt, 0), current_balance) END AS chargoff_refine,
    CAST(terms_amt AS DOUBLE) * coalesce(f.per_month, 1) AS terms_pay
  FROM {{bureau_account}} AS a LEFT JOIN factors AS f ON f.freq = a.terms_frequency
  WHERE {FILTER[product]} AND tu_consumer_id IN (SELECT tu_consumer_id FROM crc))"""


def accounts(product: str) -> str:
    """… <p>_clean: cleaned accounts of one product family.  Needs crc and factors."""
    p = product.lower()
    lines = """SELECT tu_trade_id FROM {0} WHERE cr_lmt >= 50000 OR 'SB' IN (coalesce(narrative_code1, ''), coalesce(narrative_code2, ''))"""
    ctes = [_amounts(f"{p}_amt", product)]
    if product == "ML":
        ctes.append(f"""{p}_kept AS (SELECT a.*, CAST(tu_trade_id IN (SELECT tu_trade_id FROM {p}_amt WHERE insurance_indicator = 'Y'
          AND run_date >= {CONTEXT}) AS INT) AS ml_insured FROM {p}_amt AS a)""")
    elif product == "HELOC":
        ctes.append(f"{p}_kept AS (SELECT * FROM {p}_amt WHERE tu_trade_id IN ({lines.format(f'{p}_amt')}))")
    elif product == "OTHER":
        ctes.append(_amounts("line_amt", "HELOC"))
        ctes.append(f"""{p}_marked AS (SELECT *, tu_trade_id IN ({lines.format('line_amt')}) AS is_line,
          'SB' IN (coalesce(narrative_code1, ''), coalesce(narrative_code2, '')) AS secured, product_type = 'IL' AS inst FROM {p}_amt)""")
        ctes.append(f"""{p}_cat AS (SELECT *, CASE WHEN product_type = 'LC' AND (is_line OR secured) THEN 'HELOC'
          WHEN product_type IN ('ML', 'BC', 'LC', 'AL', 'SL') THEN product_type
          WHEN acct_type <> 'I' THEN CASE product_type WHEN 'UT' THEN 'UT' ELSE 'Other' END
          WHEN coalesce(terms_dur, 0) > 96 OR (inst AND cr_lmt > 65000) THEN 'IL_unusual'
          WHEN coalesce(l3, '') IN ('EasyFinancial', 'CITI Financial', 'National Money Mart') THEN 'h_int_IL'
          WHEN inst AND cr_lmt >= 15000 AND cr_lmt <= 65000 THEN 'AL_Dcr'
          WHEN inst AND secured THEN 'AL_Dsb' ELSE 'IL' END AS product_cat FROM {p}_marked)""")
        ctes.append(f"{p}_kept AS (SELECT * FROM {p}_cat WHERE product_cat <> 'HELOC')")
    else:
        ctes.append(f"{p}_kept AS (SELECT * FROM {p}_amt)")
    ctes.append(f"""{p}_fresh AS (SELECT * FROM {p}_kept WHERE current_balance IS NOT NULL AND cr_lmt <> 0 AND run_date >= {CONTEXT}
      AND (last_updated_date >= {months('run_date', -3)} OR mop IN ('7', '8', '9')))""")
    ctes.append(f"""{p}_pair AS (
      SELECT n.*, q.tu_trade_id AS last_id, q.current_balance AS last_bal, q.chargoff_refine AS last_chg, q.closed_indic AS last_closed,
        q.acct_type AS last_type
      FROM {p}_fresh AS n LEFT JOIN {p}_fresh AS q ON q.tu_trade_id = n.tu_trade_id AND q.run_date = {months('n.run_date', -1)})""")
    ctes.append(f"""{p}_status AS (
      SELECT *, CASE WHEN last_id IS NOT NULL THEN 'exist' WHEN opened_date >= {months('run_date', -6)} THEN 'new' ELSE 'legacy' END AS new_file,
        CASE WHEN current_balance = 0 AND (coalesce(closed_indic, '') = 'Y' OR acct_type IN ('M', 'I')) THEN 'PD'
          WHEN current_balance > 0 AND chargoff_refine >= current_balance THEN 'WO'
          WHEN current_balance > 0 AND closed_indic = 'Y' THEN 'AC' ELSE 'N' END AS terminal,
        CASE WHEN last_id IS NOT NULL AND NOT (last_bal > 0 AND last_chg >= last_bal) AND current_balance > 0
          AND chargoff_refine >= current_balance THEN chargoff_refine ELSE 0 END AS chargoff_new
      FROM {p}_pair
      WHERE last_id IS NULL OR NOT (last_bal = 0 AND current_balance = 0 AND (last_closed = 'Y' OR last_type IN ('M', 'I'))))""")
    ctes.append(f"{p}_live AS (SELECT * FROM {p}_status WHERE NOT (new_file = 'legacy' AND terminal = 'PD'))")
    carried = CARRIED.replace("paymt_pat", "pat12 AS paymt_pat")
    qualified = ", ".join("v." + c.strip() for c in carried.split(",")) + ", " + ", ".join(
        "v." + c.strip() for c in OWN[product].split(",")
    )
    ctes.append(f"""{p}_clean AS (
      SELECT {qualified}, v.new_file, v.terminal, v.chargoff_new, g.n_now
      FROM {p}_live AS v LEFT JOIN (SELECT run_date, joint_account_id, COUNT(tu_consumer_id) AS n_now FROM {p}_live GROUP BY 1, 2) AS g
        ON g.run_date = v.run_date AND g.joint_account_id = v.joint_account_id
      WHERE v.run_date >= {START})""")
    return ",\n".join(ctes)


PLACE = ("fsa", "encrypted_ldu", "prov", "distance_min", "fm_damage")


def adjusted(product: str) -> str:
    """… <p>_adj: point-in-time rebuild, rating revision, deferral adjustment, loan origin."""
    p = product.lower()
    ref_after = floor_month(months("reported_date", 1))
    ctes = [
        f"""{p}_refs AS (SELECT tu_trade_id, {ref_after} AS ref_date FROM {p}_clean UNION
          SELECT tu_trade_id, {floor_month('run_date')} FROM {p}_clean)""",
        f"{p}_latest AS (SELECT tu_trade_id, reported_date, max(run_date) AS last_run FROM {p}_clean GROUP BY 1, 2)",
        f"""{p}_chosen AS (SELECT r.tu_trade_id, r.ref_date, max(l.last_run) AS pick FROM {p}_refs AS r JOIN {p}_latest AS l
          ON l.tu_trade_id = r.tu_trade_id AND l.reported_date BETWEEN {months('r.ref_date', -3)} AND r.ref_date GROUP BY 1, 2)""",
        f"""{p}_built AS (SELECT h.ref_date, a.*, c.treated_ind, {', '.join('c.' + x for x in PLACE)}
          FROM {p}_chosen AS h JOIN {p}_clean AS a ON a.tu_trade_id = h.tu_trade_id AND a.run_date = h.pick
          LEFT JOIN crc AS c ON c.tu_consumer_id = a.tu_consumer_id AND c.run_date = a.run_date
          WHERE NOT (a.terminal = 'PD' AND h.ref_date >= {months('a.reported_date', 1)}))""",
        f"""{p}_offs AS (SELECT b.*, v.paymt_pat AS rev_pat, v.months_reviewed - b.months_reviewed + 1 AS off
          FROM {p}_built AS b LEFT JOIN (SELECT * FROM {p}_built WHERE ref_date = DATE '2017-02-01') AS v
          ON v.tu_trade_id = b.tu_trade_id AND b.ref_date BETWEEN DATE '2016-06-01' AND v.ref_date)""",
        f"""{p}_rev AS (SELECT *, CASE WHEN rev_pat IS NULL THEN mop
            WHEN substr(rev_pat, CASE WHEN off = 0 THEN 1 ELSE off END, 1) <> mop THEN substr(rev_pat, CASE WHEN off = 0 THEN 1 ELSE off END, 1)
            ELSE mop END AS mop_rev FROM {p}_offs)""",
        f"""{p}_bad AS (SELECT tu_trade_id, ref_date FROM {p}_rev WHERE treated_ind = 1 AND NOT regexp_matches(mop_rev, '[X01]'))""",
        f"""{p}_lasting AS (SELECT tu_trade_id FROM {p}_bad WHERE ref_date BETWEEN DATE '2016-03-01' AND DATE '2016-05-01'
          UNION SELECT tu_trade_id FROM {p}_bad WHERE ref_date BETWEEN DATE '2016-11-01' AND DATE '2016-12-01')""",
        f"""{p}_relieved AS (SELECT *, CASE WHEN treated_ind = 1 AND NOT regexp_matches(mop_rev, '[X01]')
            AND ref_date BETWEEN DATE '2016-06-01' AND DATE '2016-10-01' AND tu_trade_id NOT IN (SELECT tu_trade_id FROM {p}_lasting)
            THEN '1' ELSE mop_rev END AS mop_adj FROM {p}_rev)""",
    ]
    columns = ", ".join(
        c.strip() for c in f"{CARRIED}, {OWN[product]}, new_file, terminal, chargoff_new, n_now, ref_date, treated_ind, mop_rev".split(",")
        if c.strip() != "mop"
    )
    if product in ("ML", "HELOC"):
        ctes.append(f"""{p}_firsts AS (SELECT tu_trade_id, min(ref_date) AS first_ref FROM {p}_built
          WHERE fsa IS NOT NULL AND encrypted_ldu IS NOT NULL GROUP BY 1)""")
        ctes.append(f"""{p}_origin AS (SELECT b.tu_trade_id, {', '.join(f'b.{x} AS {x}_{p}' for x in PLACE)} FROM {p}_built AS b
          JOIN {p}_firsts AS f ON f.tu_trade_id = b.tu_trade_id AND f.first_ref = b.ref_date)""")
        qualified = ", ".join("r." + c.strip() for c in columns.split(","))
        ctes.append(f"""{p}_adj AS (SELECT {qualified}, r.mop AS mop_raw, r.mop_adj AS mop, {', '.join(f'o.{x}_{p}' for x in PLACE)}
          FROM {p}_relieved AS r LEFT JOIN {p}_origin AS o ON o.tu_trade_id = r.tu_trade_id)""")
    else:
        ctes.append(f"{p}_adj AS (SELECT {columns}, mop AS mop_raw, mop_adj AS mop FROM {p}_relieved)")
    return ",\n".join(ctes)


def individual(product: str) -> str:
    """… <p>_ind: consumer × month (× loan location) measures, totals and active counts joined back."""
    p = product.lower()
    place = [f"{x}_{p}" for x in PLACE] if product in ("ML", "HELOC") else []
    keys = ", ".join(["tu_consumer_id", "ref_date", *place])

    def total(name: str, test: str, value: str) -> str:
        return f"CAST(SUM(CASE WHEN {test} THEN {value} ELSE 0 END) AS BIGINT) AS {p}_{name}"

    def block(extra: str = "", suffix: str = "") -> list[str]:
        return [
            total(f"bal{suffix}", f"terminal <> 'WO'{extra}", "current_balance"),
            total(f"bal_arr{suffix}", f"mop IN ('4', '5') AND terminal <> 'WO'{extra}", "current_balance"),
            total(f"bal_def{suffix}", f"mop IN ('7', '8', '9') AND terminal <> 'WO'{extra}", "current_balance"),
            total(f"chargoff{suffix}", f"terminal = 'WO'{extra}", "chargoff_refine"),
            total(f"chargoff_new{suffix}", f"terminal = 'WO'{extra}", "chargoff_new"),
        ]

    parts = block() + (block(" AND ml_insured = 1", "_ins") if product == "ML" else [])
    match = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    return f"""{p}_sums AS (SELECT {keys}, {', '.join(parts)} FROM {p}_adj GROUP BY {keys}),
{p}_active AS (SELECT {keys}, COUNT(tu_trade_id) AS n_{p}, CAST(SUM(cr_lmt) AS BIGINT) AS {p}_lmt FROM {p}_adj
  WHERE terminal NOT IN ('PD', 'WO') GROUP BY {keys}),
{p}_ind AS (SELECT b.*, a.n_{p}, a.{p}_lmt FROM {p}_sums AS b LEFT JOIN {p}_active AS a ON {match})"""


def products(*names: str) -> str:
    """All CTEs from the consumer panel to <p>_ind for the named families."""
    parts = [consumer(), FACTORS]
    for name in names:
        parts += [accounts(name), adjusted(name), individual(name)]
    return ",\n".join(parts)


def merged() -> str:
    """… df_ind: consumer panel with the four product blocks, treated and control areas only."""
    flow = ["bal", "bal_arr", "bal_def", "chargoff_new"]
    ml = [f"ml_{m}" for m in flow] + [f"ml_{m}_ins" for m in flow]
    heloc = [f"heloc_{m}" for m in flow]
    bc = [f"bc_{m}" for m in flow] + ["bc_lmt"]
    other = [f"other_{m}" for m in flow]
    zero = ", ".join(f"coalesce({m}, 0) AS {m}" for m in ml + heloc + bc + other)
    on = "ON {0}.tu_consumer_id = crc.tu_consumer_id AND {0}.ref_date = crc.run_date"

    def roll(name: str, columns: list[str]) -> str:
        sums = ", ".join(f"CAST(SUM({m}) AS BIGINT) AS {m}" for m in columns)
        return f"{name}_c AS (SELECT tu_consumer_id, ref_date, {sums} FROM {name}_ind GROUP BY 1, 2)"

    return f"""{roll('ml', ml)}, {roll('heloc', heloc)},
df_all AS (
  SELECT crc.tu_consumer_id, crc.run_date, crc.fsa, crc.prov, crc.fm_damage, coalesce(crc.cvsc100, 0) AS cvsc100,
    coalesce(crc.distance_min, 0) AS distance_min, {zero},
    CAST(ml_c.ref_date IS NOT NULL AS INT) AS ml_exist, CAST(heloc_c.ref_date IS NOT NULL AS INT) AS heloc_exist,
    CAST(bc_ind.ref_date IS NOT NULL AS INT) AS bc_exist, CAST(other_ind.ref_date IS NOT NULL AS INT) AS other_exist
  FROM crc LEFT JOIN ml_c {on.format('ml_c')} LEFT JOIN heloc_c {on.format('heloc_c')}
  LEFT JOIN bc_ind {on.format('bc_ind')} LEFT JOIN other_ind {on.format('other_ind')}),
df_ind AS (
  SELECT *, CAST({IN_AREA.format('fsa')} AS INT) AS treated FROM df_all
  WHERE {IN_AREA.format('fsa')} OR (regexp_matches(prov, 'AB|SK') AND distance_min >= 100))"""
