"""Common table expressions of the SQL twins (DuckDB dialect)."""

from motionframe.sources.binding import SCORERS

_PARTS = {}


def part(name, text, *needs):
    _PARTS[name] = (text.strip(), needs)


def ctes(*names):
    """WITH clause holding the named parts and everything they need, in order."""
    seen = []

    def add(name):
        text, needs = _PARTS[name]
        for n in needs:
            add(n)
        if name not in seen:
            seen.append(name)

    for n in names:
        add(n)
    # Materialised parts keep join inputs plain; the engine's join fails on some inlined ones.
    kind = lambda n: "" if n.endswith("_acc") else "MATERIALIZED "
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {kind(n)}(\n{_PARTS[n][0]}\n)" for n in seen) + "\n"


part("samples", """
SELECT concat('r', l_suppkey, '_', l_returnflag) AS recording_id, l_suppkey AS suppkey, l_returnflag AS flag,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample_idx,
  (l_quantity - 25.5) / 5.0 AS ax, (l_extendedprice - 45000.0) / 10000.0 AS ay,
  9.80665::DOUBLE + (l_discount - 0.05) * 20.0 AS az, (l_tax - 0.04) * 50.0 AS gx,
  (l_linenumber - 4)::DOUBLE * 0.5::DOUBLE AS gy, ((l_partkey % 100)::DOUBLE - 49.5) / 50.0::DOUBLE AS gz
FROM lineitem
""")
part("seqs", """
SELECT concat('r', l_suppkey, '_', l_returnflag) AS recording_id, n_name AS dataset_id,
  concat('p', l_suppkey) AS participant_id, r_name AS body_location, l_suppkey AS suppkey,
  l_returnflag AS flag, count(*) AS n,
  CASE WHEN l_returnflag = 'N' THEN 'recording' ELSE 'temporal' END AS supervision_kind,
  CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'N' THEN l_suppkey % 4 = 0 ELSE false END AS is_fall,
  CASE WHEN l_suppkey % 11 = 0 THEN -1 ELSE l_suppkey % 5 END AS fold_id
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ALL
""")
part("ev", """
SELECT recording_id, half, impact - 15 AS onset, impact, impact + 20 AS stop, n, concat('F0', half) AS code
FROM (SELECT s.recording_id, q.n, CASE WHEN s.sample_idx < q.n // 2 THEN 1 ELSE 2 END AS half,
        s.sample_idx AS impact, row_number() OVER (PARTITION BY s.recording_id,
          CASE WHEN s.sample_idx < q.n // 2 THEN 1 ELSE 2 END
          ORDER BY s.ax*s.ax + s.ay*s.ay DESC, s.sample_idx) AS rn
      FROM samples s JOIN seqs q USING (recording_id)
      WHERE q.flag = 'R' AND (s.sample_idx BETWEEN 20 AND q.n // 2 - 25
        OR s.sample_idx BETWEEN q.n // 2 + 20 AND q.n - 25)) WHERE rn = 1
""", "samples", "seqs")
part("ann", """
SELECT * FROM (
  SELECT recording_id, 'activity' AS kind, 0 AS start_sample, n AS stop_sample, 'ADL' AS code FROM seqs WHERE flag = 'A'
  UNION ALL SELECT recording_id, 'exclude', n - 5, n, 'other' FROM seqs WHERE flag = 'R' AND recording_id IN (SELECT recording_id FROM ev)
  UNION ALL SELECT recording_id, 'activity', onset, stop, code FROM ev
  UNION ALL SELECT recording_id, 'onset', onset, onset, code FROM ev
  UNION ALL SELECT recording_id, 'impact', impact, impact, code FROM ev
  UNION ALL SELECT recording_id, 'activity', 0, onset, 'ADL' FROM ev WHERE half = 1
  UNION ALL SELECT a.recording_id, 'activity', a.stop, b.onset, 'ADL' FROM ev a JOIN ev b USING (recording_id) WHERE a.half = 1 AND b.half = 2
  UNION ALL SELECT recording_id, 'activity', stop, n - 5, 'ADL' FROM ev WHERE half = 2
) WHERE kind IN ('onset', 'impact') OR start_sample < stop_sample
""", "ev")
part("grid", """
SELECT q.*, k AS win, floor(k * 12.5 + 0.5)::INTEGER AS start_sample, floor(k * 12.5 + 0.5)::INTEGER + 50 AS end_sample
FROM (SELECT *, unnest(range(0, n)) AS k FROM seqs WHERE n >= 50) q
WHERE floor(k * 12.5 + 0.5) <= n - 50
""", "seqs")
part("marked", """
SELECT *, temporal AND ex AS drop_excluded, temporal AND NOT ex AND NOT hit AND tl AS drop_post,
  NOT ((temporal AND ex) OR (temporal AND NOT ex AND NOT hit AND tl)) AS kept,
  CASE WHEN temporal THEN hit::INTEGER WHEN is_fall THEN -1 ELSE 0 END AS temporal_label,
  is_fall::INTEGER AS bag_label
FROM (SELECT g.*, supervision_kind = 'temporal' AS temporal,
  EXISTS (SELECT 1 FROM ev e WHERE e.recording_id = g.recording_id AND g.end_sample - 1 >= e.onset AND g.end_sample - 1 < e.stop) AS hit,
  EXISTS (SELECT 1 FROM ann a WHERE a.kind = 'exclude' AND a.recording_id = g.recording_id AND g.start_sample < a.stop_sample AND g.end_sample > a.start_sample) AS ex,
  EXISTS (SELECT 1 FROM ev e WHERE e.recording_id = g.recording_id AND g.start_sample < e.stop AND g.end_sample - 1 >= e.stop) AS tl
 FROM grid g)
""", "grid", "ev", "ann")
part("kept", """
SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY end_sample, start_sample) - 1 AS pos FROM marked WHERE kept
""", "marked")
part("wrows", """
SELECT s.*, g.win, (s.sample_idx - g.start_sample)::INTEGER AS p, sqrt(ax*ax + ay*ay + az*az) AS acc_norm, sqrt(gx*gx + gy*gy + gz*gz) AS gyr_norm
FROM samples s JOIN grid g USING (recording_id) WHERE s.sample_idx >= g.start_sample AND s.sample_idx < g.end_sample
""", "samples", "grid")
part("impact", """
SELECT recording_id, win, max(abs(acc_norm - 9.80665::DOUBLE)) / 9.80665::DOUBLE AS acc_part,
  max(gyr_norm) / 6.283185307179586::DOUBLE AS gyr_part,
  max(abs(acc_norm - 9.80665::DOUBLE)) / 9.80665::DOUBLE + max(gyr_norm) / 6.283185307179586::DOUBLE AS impact_score
FROM wrows GROUP BY recording_id, win
""", "wrows")
part("scored", "SELECT k.*, acc_part, gyr_part, impact_score FROM kept k JOIN impact USING (recording_id, win)", "kept", "impact")
_rows = ", ".join(
    f"('{m}', '{r}', {s}, {a}::DOUBLE, {g}::DOUBLE, {'NULL' if o is None else o}::DOUBLE)"
    for m, r, s, a, g, o in SCORERS
)
part("scorers", f"SELECT * FROM (VALUES {_rows}) AS t(model_id, recipe, seed, wa, wg, off)")
part("scores", """
SELECT model_id, recipe, fold, seed, split, recording_id, dataset_id, participant_id, body_location, is_fall, n, win,
  start_sample, end_sample, pos, temporal_label AS label,
  (CASE WHEN off IS NULL THEN b ELSE b / (b + off) END)::FLOAT::DOUBLE AS score
FROM (SELECT s.*, m.*, acc_part * wa + gyr_part * wg AS b, r.split,
        CASE WHEN r.split = 'test' THEN fold_id ELSE (fold_id + 4) % 5 END AS fold
      FROM scored s CROSS JOIN scorers m CROSS JOIN (VALUES ('test'), ('validation')) r(split)
      WHERE temporal_label >= 0 AND fold_id >= 0)
""", "scored", "scorers")

# -- metrics ----------------------------------------------------------------
J = "model_id, recipe, fold, seed"
JL = "model_id, recipe, fold::BIGINT AS fold, seed::BIGINT AS seed"

part("curve", f"""
SELECT *, sum(pos_n) OVER w AS tp, sum(neg_n) OVER w AS fp,
  sum(pos_n) OVER (PARTITION BY {J}, split) AS p, sum(neg_n) OVER (PARTITION BY {J}, split) AS q
FROM (SELECT {J}, split, score, count(*) FILTER (label = 1) AS pos_n, count(*) FILTER (label = 0) AS neg_n
      FROM scores GROUP BY ALL)
WINDOW w AS (PARTITION BY {J}, split ORDER BY score DESC)
""", "scores")
part("cand", f"""
SELECT {J}, split, score AS t, tp, fp, p, q FROM curve
UNION ALL
SELECT {J}, split, nextafter(max(score), 'infinity'::DOUBLE), 0, 0, max(p), max(q) FROM curve GROUP BY {J}, split
""", "curve")
part("graded", "SELECT *, (tp::DOUBLE / p + (1.0::DOUBLE - fp::DOUBLE / q)) / 2.0::DOUBLE AS bacc FROM cand", "cand")
part("thr_all", f"""
SELECT {J}, split, t AS threshold, best AS balanced_accuracy,
  CASE WHEN tp + fp = 0 OR (q - fp) + (p - tp) = 0 OR p = 0 OR q = 0 THEN 0.0
    ELSE (tp::DOUBLE * (q - fp) - fp::DOUBLE * (p - tp)) / (sqrt((tp + fp)::DOUBLE) * sqrt(p::DOUBLE) * sqrt(q::DOUBLE) * sqrt(((q - fp) + (p - tp))::DOUBLE)) END AS mcc
FROM (SELECT *, row_number() OVER (PARTITION BY {J}, split ORDER BY abs(t - 0.5), t) AS rn
      FROM (SELECT *, max(bacc) OVER (PARTITION BY {J}, split) AS best FROM graded) WHERE bacc >= best - 1e-12)
WHERE rn = 1
""", "graded")
part("thr", f"SELECT {J}, threshold, balanced_accuracy, mcc FROM thr_all WHERE split = 'validation'", "thr_all")
part("withthr", f"SELECT s.*, threshold, score >= threshold AS alert, end_sample - 1 AS decision FROM scores s JOIN thr USING ({J})", "scores", "thr")
part("test", "SELECT * FROM withthr WHERE split = 'test'", "withthr")


def rates(prefix=""):
    """Rate columns from counts n, positive, tn, fp, fn, tp."""
    return """
  CASE WHEN n > 0 THEN (tp + tn)::DOUBLE / n ELSE 0 END AS accuracy,
  CASE WHEN positive > 0 AND positive < n THEN (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END AS balanced_accuracy,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS sensitivity,
  CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS specificity,
  CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS "precision",
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN positive > 0 AND positive < n THEN CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0 ELSE
    (tp::DOUBLE * tn - fp::DOUBLE * fn) / (sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE)) END END AS mcc"""


COUNTS = """count(*) AS n, count(*) FILTER (label = 1) AS positive,
  count(*) FILTER (NOT alert AND label = 0) AS tn, count(*) FILTER (alert AND label = 0) AS fp,
  count(*) FILTER (NOT alert AND label = 1) AS fn, count(*) FILTER (alert AND label = 1) AS tp"""
part("conf", f"SELECT {J}, {COUNTS} FROM test GROUP BY {J}", "test")
part("cls", f"SELECT *, {rates()} FROM conf", "conf")
part("rnk", f"""
SELECT {J}, sum(neg_n * (tp - pos_n + pos_n / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(q)) AS auroc,
  sum(pos_n * (tp::DOUBLE / (tp + fp))) / max(p) AS auprc
FROM curve WHERE split = 'test' GROUP BY {J}
""", "curve")


def events_sql(name, source, scope_sql):
    """Window-level event metrics over ``source`` (score rows) and a scope of (job, seq)."""
    part(f"{name}_scope", scope_sql, source)
    part(f"{name}_cov", f"""
SELECT {J}, recording_id, e.onset, e.impact, e.stop, e.code, min(decision) FILTER (alert) AS first_alert
FROM {source} s JOIN ev e USING (recording_id) WHERE decision >= e.onset AND decision < e.stop GROUP BY ALL
""", source, "ev")
    part(f"{name}_tot", f"""
SELECT {J}, coalesce(sum(c), 0) AS fall_events, count(*) FILTER (NOT is_fall) AS adl_recordings
FROM {name}_scope LEFT JOIN (SELECT recording_id, count(*) AS c FROM ev GROUP BY 1) USING (recording_id) GROUP BY {J}
""", f"{name}_scope", "ev")
    part(name, f"""
SELECT {J}, t.fall_events, coalesce(c.d, 0) AS detected_events, t.fall_events - coalesce(c.covered, 0) AS uncovered,
  t.adl_recordings, w.adl_fp_rec, w.hours, w.fpw, c.lat50, c.lat95, c.imp50
FROM {name}_tot t JOIN (
  SELECT {J}, count(DISTINCT recording_id) FILTER (NOT is_fall AND alert AND label = 0) AS adl_fp_rec,
    count(*) FILTER (label = 0) * 0.5::DOUBLE / 3600.0::DOUBLE AS hours, count(*) FILTER (label = 0 AND alert) AS fpw FROM {source} GROUP BY {J}) w USING ({J})
LEFT JOIN (SELECT {J}, count(*) AS covered, count(first_alert) AS d,
    quantile_cont((first_alert - onset) / 25.0::DOUBLE, 0.5) AS lat50, quantile_cont((first_alert - onset) / 25.0::DOUBLE, 0.95) AS lat95,
    quantile_cont((first_alert - impact) / 25.0::DOUBLE, 0.5) AS imp50 FROM {name}_cov GROUP BY {J}) c USING ({J})
""", f"{name}_tot", f"{name}_cov")


FOLD_SCOPE = f"""
SELECT {J}, q.recording_id, q.is_fall FROM (SELECT DISTINCT {J} FROM test) j
  JOIN seqs q ON q.fold_id = j.fold AND q.n >= 50"""
events_sql("evm", "test", FOLD_SCOPE)


def policies_sql(policies):
    from motionframe.operators.alarms import cooldown_samples

    rows = ", ".join(
        f"('{i}', {m if c else r}, {m}, {cooldown_samples(s)})" for i, r, m, c, s in policies
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(policy, need, m, cd)"


def alarms_sql(name, source, scope_sql, policies, keys=J, stride=0.5):
    """Alarm metrics over ``source``; greedy cooldown as a recursive step to the next trigger."""
    part(f"{name}_pol", policies_sql(policies))
    part(f"{name}_scope", scope_sql, source)
    part(f"{name}_trig", f"""
SELECT {keys}, policy, cd, recording_id, is_fall, decision FROM (
  SELECT {keys}, policy, cd, need, m, recording_id, is_fall, decision,
    row_number() OVER (PARTITION BY {keys}, policy, recording_id ORDER BY decision) AS rn,
    CASE m WHEN 1 THEN alert::INTEGER
      WHEN 2 THEN sum(alert::INTEGER) OVER (PARTITION BY {keys}, policy, recording_id ORDER BY decision ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
      WHEN 3 THEN sum(alert::INTEGER) OVER (PARTITION BY {keys}, policy, recording_id ORDER BY decision ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
      ELSE sum(alert::INTEGER) OVER (PARTITION BY {keys}, policy, recording_id ORDER BY decision ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS c
  FROM {source}, {name}_pol) WHERE rn >= m AND c >= need
""", source, f"{name}_pol")
    part(f"{name}_acc", f"""
SELECT {keys}, policy, cd, recording_id, is_fall, min(decision) AS decision FROM {name}_trig GROUP BY {keys}, policy, cd, recording_id, is_fall
UNION ALL
SELECT {keys}, policy, cd, recording_id, is_fall, decision FROM (
  SELECT t.*, row_number() OVER (PARTITION BY {', '.join('t.' + k.strip() for k in keys.split(','))}, t.policy, t.recording_id ORDER BY t.decision) AS rn
  FROM {name}_acc a JOIN {name}_trig t USING ({keys}, policy, recording_id)
  WHERE t.decision >= a.decision + greatest(a.cd, 1)) WHERE rn = 1
""", f"{name}_trig")
    part(f"{name}_al", f"""
SELECT a.*, EXISTS (SELECT 1 FROM ev e WHERE e.recording_id = a.recording_id AND a.decision >= e.onset AND a.decision < e.stop) AS in_event FROM {name}_acc a
""", f"{name}_acc", "ev")
    part(f"{name}_det", f"""
SELECT {keys}, policy, count(*) AS d, quantile_cont((f - onset) / 25.0::DOUBLE, 0.5) AS lat50,
  quantile_cont((f - onset) / 25.0::DOUBLE, 0.95) AS lat95, quantile_cont((f - impact) / 25.0::DOUBLE, 0.5) AS imp50
FROM (SELECT {keys}, policy, recording_id, e.onset, e.impact, e.code, min(decision) AS f
      FROM {name}_al a JOIN ev e USING (recording_id) WHERE decision >= e.onset AND decision < e.stop GROUP BY ALL) GROUP BY {keys}, policy
""", f"{name}_al")
    part(f"{name}_fa", f"""
SELECT {keys}, policy, count(*) AS episodes, count(DISTINCT recording_id) FILTER (NOT is_fall) AS adl_fp_rec FROM {name}_al WHERE NOT in_event GROUP BY {keys}, policy
""", f"{name}_al")
    part(f"{name}_base", f"""
SELECT {keys}, count(*) FILTER (label = 0) * {stride}::DOUBLE / 3600.0::DOUBLE AS hours,
  count(DISTINCT recording_id) FILTER (NOT is_fall) AS adl_recordings FROM {source} GROUP BY {keys}
""", source)
    part(f"{name}_tot", f"""
SELECT {keys}, count(e.onset) AS fall_events FROM {name}_scope s LEFT JOIN ev e ON e.recording_id = s.recording_id GROUP BY {keys}
""", f"{name}_scope", "ev")
    part(f"{name}_cov", f"""
SELECT {keys}, count(*) AS covered FROM (SELECT DISTINCT {keys}, recording_id, e.onset, e.code
  FROM {source} s JOIN ev e USING (recording_id) WHERE decision >= e.onset AND decision < e.stop) GROUP BY {keys}
""", source, "ev")
    part(f"{name}_row", f"""
SELECT {keys}, policy, fall_events, coalesce(covered, 0) AS covered, adl_recordings, hours
FROM {name}_base JOIN {name}_tot USING ({keys}) LEFT JOIN {name}_cov USING ({keys}) CROSS JOIN {name}_pol
""", f"{name}_base", f"{name}_tot", f"{name}_cov", f"{name}_pol")
    part(name, f"""
SELECT {keys}, policy AS alarm_policy_id, fall_events, coalesce(d, 0) AS detected_events, fall_events - covered AS uncovered,
  adl_recordings, coalesce(adl_fp_rec, 0) AS adl_fp_rec, hours, coalesce(episodes, 0) AS episodes, lat50, lat95, imp50,
  CASE WHEN fall_events > 0 THEN coalesce(d, 0)::DOUBLE / fall_events ELSE 0 END AS event_sensitivity,
  CASE WHEN hours > 0 THEN coalesce(episodes, 0) / hours ELSE 0 END AS episodes_per_hour
FROM {name}_row LEFT JOIN {name}_det USING ({keys}, policy) LEFT JOIN {name}_fa USING ({keys}, policy)
""", f"{name}_det", f"{name}_fa", f"{name}_row")
