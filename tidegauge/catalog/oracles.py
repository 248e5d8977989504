"""SQL twins of the queries, for an independent engine on the same tables.

They follow the definitions directly: allocations come from a recursive
one-executor-at-a-time loop, waits from the blocking recursion at each count.
"""

from __future__ import annotations

# Parameters shared with the queries.
HISTORY = 5
BUDGET = 18
QOS_MS = 450.0
SAMPLE_N = 3
PATH_P = 0.6
LOOP_P = 0.2
PEEK = 100
RAW = 200
CURVE_MORE = 8
LONGEST = 9
LARGE_BUDGET = 128

DAY_US = 86400 * 1000000
T0 = "TIMESTAMP '2024-01-01 00:00:00'"
INDEX = ("CASE component WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
         "WHEN 'signup' THEN 3 ELSE 4 END")
CUTS = (10, 25, 50, 100, 200)

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTE[name] = (needs, sql)


def tick(ts: str) -> str:
    return f"CAST(greatest(1, floor((epoch_us({ts}) - epoch_us({T0})) / {DAY_US}.0)) AS INTEGER)"


def r6(expr: str, name: str) -> str:
    return f"round(CASE WHEN isfinite({expr}) THEN {expr} END, 6) AS {name}"


def r11(expr: str, name: str) -> str:
    return f"round(CASE WHEN isfinite({expr}) THEN {expr} END, 11) AS {name}"


def sums(prefix: str = "") -> str:
    return f"CAST(sum({prefix}cnt) AS BIGINT) AS cnt, round(sum({prefix}s), 6) AS s, round(sum({prefix}ss), 6) AS ss"


def with_ctes(names: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in CTE[name][0]:
            visit(needed)
        order.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + body


cte("te", (), f"""
SELECT job, ts, event_id, component, kind,
       CAST(({INDEX}) * 8 + CAST(floor(user_id / 4) AS BIGINT) % 8 AS INTEGER) AS task,
       stream, elapsed_ms, outcome, user_id,
       CASE WHEN (kind <> 'source' OR outcome = 'ok') AND (kind = 'source' OR elapsed_ms > 0) THEN elapsed_ms END AS x
FROM (SELECT 'job' || CAST(user_id % 4 AS VARCHAR) AS job, ts, event_id, event_type AS component, user_id,
             CASE WHEN event_type = 'view' THEN 'source' ELSE 'service' END AS kind,
             's' || CAST(event_id % 2 AS VARCHAR) AS stream,
             value * CASE WHEN event_type = 'view' THEN 8 ELSE 1 END AS elapsed_ms,
             CASE WHEN event_id % 50 = 0 THEN 'fail' ELSE 'ok' END AS outcome
      FROM events)""")
cte("comp", ("te",), "SELECT DISTINCT job, component, kind FROM te")
cte("ex", ("comp",), f"""
SELECT job, component, kind, CAST(({INDEX}) * 8 + 2 * e AS INTEGER) AS task_start,
       CAST(({INDEX}) * 8 + 2 * e + 1 AS INTEGER) AS task_end,
       'h' || CAST(e % 3 AS VARCHAR) AS host, CAST(6700 + e AS INTEGER) AS port
FROM comp, range(4) r(e)""")
cte("xt", ("ex",), """
SELECT job, component, kind, task_start AS executor, host, port, CAST(task_start + o AS INTEGER) AS task
FROM ex, range(2) r(o)""")
cte("td", ("te",), """
SELECT job, date_trunc('day', ts)::TIMESTAMP AS day, component, kind, task, stream, count(*) AS arrivals,
       sum(elapsed_ms) AS total_ms, count(x) AS cnt, coalesce(sum(x), 0) AS s, coalesce(sum(x * x), 0) AS ss
FROM te GROUP BY ALL""")
cte("tm", ("td",), f"""
SELECT job, {tick('day')} AS tick, component, kind, task, stream,
       CAST(sum(cnt) AS BIGINT) AS cnt, sum(s) AS s, sum(ss) AS ss
FROM td GROUP BY ALL HAVING sum(cnt) > 0""")
cte("xd", ("td", "xt"), """
SELECT td.job, td.day, td.component, td.kind, xt.executor, sum(arrivals) AS arrivals, sum(total_ms) AS total_ms,
       sum(cnt) AS cnt, sum(s) AS s, sum(ss) AS ss
FROM td JOIN xt ON td.job = xt.job AND td.task = xt.task GROUP BY ALL""")
cte("er", ("xd",), f"""
SELECT job, {tick('day')} AS tick, day, component, kind, executor, cnt, s, ss, 86400000.0::DOUBLE AS duration_ms,
       arrivals * 259200.0 / 86400 AS recv_rate, 1024.0::DOUBLE AS recv_capacity, CAST(arrivals AS DOUBLE) AS recv_population,
       total_ms / arrivals AS recv_sojourn, arrivals * 2 * 259200.0 / 86400 AS send_rate, 1024.0::DOUBLE AS send_capacity,
       CAST(arrivals AS DOUBLE) AS send_population, total_ms / arrivals AS send_sojourn
FROM xd""")
QUEUE = [f"{q}_{m}" for q in ("recv", "send") for m in ("rate", "capacity", "population", "sojourn")]
cte("ct", ("er",), "SELECT job, tick, component, kind, sum(cnt) AS cnt, sum(s) AS s, sum(ss) AS ss, "
    "sum(duration_ms) AS duration_ms, "
    + ", ".join(f"count({c}) AS {c}_cnt, sum({c}) AS {c}_s, sum({c} * {c}) AS {c}_ss" for c in QUEUE)
    + " FROM er GROUP BY ALL")
cte("al", ("ex",), "SELECT job, component, kind, CAST(count(*) AS INTEGER) AS executors FROM ex GROUP BY ALL")
MODEL_COLUMNS = ["cnt", "s", "ss", "duration_ms", "recv_rate_cnt", "recv_rate_s", "send_rate_cnt", "send_rate_s",
                 "recv_population_cnt", "recv_population_s", "send_population_cnt", "send_population_s"]
cte("dense", ("ct", "al"), "SELECT f.job, f.component, f.kind, f.executors, f.tick, "
    + ", ".join(f"coalesce(ct.{c}, 0) AS {c}" for c in MODEL_COLUMNS)
    + """ FROM (SELECT al.job, al.component, al.kind, al.executors, CAST(unnest(range(1, last + 1)) AS INTEGER) AS tick
      FROM al JOIN (SELECT job, max(tick) AS last FROM ct GROUP BY job) l ON al.job = l.job) f LEFT JOIN ct ON f.job = ct.job AND f.component = ct.component AND f.tick = ct.tick""")
# the history as a self-join on the tick distance, not as a window frame
cte("hist_all", ("dense",), "SELECT a.job, a.component, a.kind, a.executors, a.tick, "
    + ", ".join(f"sum(b.{c}) AS {c}" for c in MODEL_COLUMNS)
    + f""" FROM dense a JOIN dense b ON a.job = b.job AND a.component = b.component
      AND b.tick BETWEEN a.tick - {HISTORY - 1} AND a.tick GROUP BY ALL""")
cte("hist", ("hist_all",), f"SELECT * FROM hist_all WHERE tick >= {HISTORY}")


def per(total: str, cnt: str) -> str:
    return f"(CASE WHEN {cnt} > 0 THEN {total} / {cnt} ELSE 0 END)"


def scv(cnt: str = "cnt", s: str = "s", ss: str = "ss") -> str:
    return f"(CASE WHEN {cnt} > 0 THEN (CASE WHEN {s} <> 0 THEN ({ss} / {cnt}) / (({s} / {cnt}) * ({s} / {cnt})) - 1 END) ELSE 0 END)"


COMPLETE = "cnt * executors / nullif(duration_ms / 1000.0, 0)"
cte("src", ("hist",), f"""
SELECT job, tick, component, executors, CAST(cnt AS BIGINT) AS completed, {per('s', 'cnt')} AS real_ms,
       {scv()} AS real_scv, duration_ms / 1000.0 AS duration_seconds, {COMPLETE} AS complete_rate,
       {per('send_rate_s', 'send_rate_cnt')} * executors / 2.0 AS emit_rate,
       {per('recv_rate_s', 'recv_rate_cnt')} * executors AS external_rate,
       {per('send_population_s', 'send_population_cnt')} AS send_length,
       {per('recv_population_s', 'recv_population_cnt')} AS recv_length
FROM hist WHERE kind = 'source'""")


def service_sql(history: str, source: str) -> str:
    lam = f"({per('h.recv_rate_s', 'h.recv_rate_cnt')} * h.executors)"
    served = per("h.s", "h.cnt")
    return f"""
SELECT h.job, h.tick, h.component, h.executors, CAST(h.cnt AS BIGINT) AS completed, {lam} AS lam,
       CASE WHEN {served} > 0 THEN 1000.0 / {served} ELSE 1.7976931348623157e308 END AS mu,
       {lam} * {served} / (h.executors * 1000.0) AS rho,
       CASE WHEN external_rate > 0 THEN {lam} / external_rate ELSE 0 END AS ratio,
       {served} AS service_ms, {scv('h.cnt', 'h.s', 'h.ss')} AS cs2, 1.0 AS ca2,
       h.duration_ms / 1000.0 AS duration_seconds,
       h.cnt * h.executors / nullif(h.duration_ms / 1000.0, 0) AS complete_rate,
       {per('h.send_population_s', 'h.send_population_cnt')} AS send_length,
       {per('h.recv_population_s', 'h.recv_population_cnt')} AS recv_length, real_ms
FROM {history} h LEFT JOIN {source} s ON h.job = s.job AND h.tick = s.tick WHERE h.kind <> 'source'"""


cte("sv", ("hist", "src"), service_sql("hist", "src"))


def erlang_b(load: str, k: str) -> str:
    return f"list_reduce(list_prepend(1.0::DOUBLE, range(1, {k} + 1)::DOUBLE[]), lambda b, i: {load} * b / (i + {load} * b))"


def wait(lam: str, mu: str, k: str) -> str:
    b = erlang_b(f"({lam} / {mu})", k)
    rho = f"({lam} / ({mu} * {k}))"
    return (f"(CASE WHEN {lam} <= 0 THEN 0 WHEN {rho} < 1 THEN "
            f"(SELECT b / (1 - {rho} * (1 - b)) / ({k} * {mu} - {lam}) FROM (SELECT {b} AS b)) "
            f"ELSE 'infinity'::DOUBLE END)")


FLOOR = "(CAST(floor(lam / mu) AS INTEGER) + 1)"


def factor(model: str) -> str:
    """Factor on the M/M/k wait, over columns lam, mu, k, ca2, cs2."""
    if model == "mmk":
        return "1.0"
    if model == "ggk_simple":
        return "coalesce((ca2 + cs2) / 2, 1.0)"
    rho = "(lam / (mu * k))"
    gamma = f"least(0.24, (1 - {rho}) * (k - 1) * (sqrt(4.0 + 5.0 * k) - 2) / (16.0 * k * {rho}))"
    return f"""coalesce((SELECT (ca2 + cs2) / 2 * CASE WHEN ca2 >= cs2
        THEN f1 * (ca2 - cs2) / (ca2 - 0.75 * cs2) + psi * cs2 / (4 * ca2 - 3 * cs2)
        ELSE f3 * 0.5 * (cs2 - ca2) / (ca2 + cs2) + psi * 0.5 * (cs2 + 3 * ca2) / (ca2 + cs2) END
      FROM (SELECT f1, f3, CASE WHEN (ca2 + cs2) / 2 < 1 THEN pow(least(1, (f1 + f3) / 2), 2 - (ca2 + cs2)) ELSE 1 END AS psi
            FROM (SELECT 1 + g AS f1, (1 - 4 * g) * exp(-2 * (1 - {rho}) / (3 * {rho})) AS f3 FROM (SELECT {gamma} AS g)))),
      (ca2 + cs2) / 2, 1.0)"""


def sojourn(model: str, w: str = "wait_s") -> str:
    return f"(CASE WHEN {w} > 0 AND isfinite({w}) THEN {w} * {factor(model)} ELSE {w} END + 1 / mu)"


def grid_sql(nodes: str, top: str) -> str:
    """Every node at every count from its floor to what is left of ``top``."""
    return f"""
SELECT n.* EXCLUDE (kk), CAST(kk AS INTEGER) AS k, {wait('n.lam', 'n.mu', 'n.kk')} AS wait_s
FROM (SELECT *, unnest(range(lo, lo + greatest({top} - floor_total, 0)::INTEGER + 2)) AS kk
      FROM (SELECT *, {FLOOR} AS lo, sum({FLOOR}) OVER (PARTITION BY job, tick) AS floor_total FROM {nodes})) n"""


def significant(x: str, digits: int = 12) -> str:
    """``x`` at so many significant digits, so equal components tie at any scale."""
    scale = f"pow(10.0::DOUBLE, {digits - 1} - floor(log10(abs({x}))))"
    return f"CASE WHEN abs({x}) > 1e-290 AND abs({x}) < 1e290 THEN round_even({x} * {scale}, 0) / {scale} ELSE {x} END"


def gains_sql(grid: str, model: str) -> str:
    return f"""
SELECT * EXCLUDE (raw), {significant('raw')} AS gain
FROM (SELECT *, (soj - lead(soj) OVER (PARTITION BY job, tick, component ORDER BY k)) * ratio AS raw
      FROM (SELECT *, {sojourn(model)} AS soj FROM {grid}))"""


def loop_sql(name: str, gains: str, top: str) -> str:
    """One more executor per step, to the component with the largest gain."""
    return f"""
SELECT job, tick, 0 AS step, component, lo AS k FROM {gains} WHERE k = lo
UNION ALL
SELECT job, tick, step + 1, component, CASE WHEN turn = 1 AND can THEN k + 1 ELSE k END
FROM (SELECT a.job, a.tick, a.step, a.component, a.k, coalesce(g.gain > -1 AND g.lam > 0, false) AS can,
             row_number() OVER (PARTITION BY a.job, a.tick, a.step
                                ORDER BY CASE WHEN g.gain > -1 AND g.lam > 0 THEN g.gain END DESC NULLS LAST,
                                         a.component) AS turn
      FROM {name} a JOIN {gains} g ON a.job = g.job AND a.tick = g.tick AND a.component = g.component AND a.k = g.k
      WHERE a.step < {top} - g.floor_total)"""


def allocation_ctes(tag: str, nodes: str, top: str, model: str, needs: tuple[str, ...]) -> None:
    cte(f"grid_{tag}", needs, grid_sql(nodes, top))
    cte(f"gain_{tag}", (f"grid_{tag}",), gains_sql(f"grid_{tag}", model))
    cte(f"loop_{tag}", (f"gain_{tag}",), loop_sql(f"loop_{tag}", f"gain_{tag}", top))
    # estimate of the M/M/k network after every step
    cte(f"step_{tag}", (f"loop_{tag}", f"gain_{tag}"), f"""
SELECT l.job, l.tick, l.step, any_value(g.floor_total) AS floor_total,
       sum(CASE WHEN g.ratio = 0 THEN 0 ELSE g.soj * g.ratio END) AS est_s
FROM loop_{tag} l JOIN gain_{tag} g ON l.job = g.job AND l.tick = g.tick AND l.component = g.component AND l.k = g.k
GROUP BY ALL""")


for _m in ("mmk", "ggk_simple", "ggk_complex"):
    allocation_ctes(_m, "sv", str(BUDGET), _m, ("sv",))
allocation_ctes("qos", "sv", str(2 * BUDGET - 1), "mmk", ("sv",))
allocation_ctes("large", "sv", str(2 * LARGE_BUDGET - 1), "mmk", ("sv",))

# allocation snapshots with the change and the gaps of the fixture, and the last one at or before every tick
cte("ticks", ("te",), f"SELECT job, CAST(unnest(range(1, max({tick('ts')}) + 1)) AS INTEGER) AS tick FROM te GROUP BY job")
cte("snap", ("comp", "ticks"), """
SELECT c.job, c.component, c.kind, t.tick,
       CAST(CASE WHEN c.job = 'job0' AND c.component = 'click' AND t.tick >= 15 THEN 6 ELSE 4 END AS INTEGER) AS executors
FROM comp c JOIN ticks t ON c.job = t.job WHERE t.tick % 5 <> 2""")
cte("alh", ("snap", "ticks"), """
SELECT t.job, s.component, s.kind, t.tick, arg_max(s.executors, s.tick) AS executors
FROM ticks t JOIN snap s ON t.job = s.job AND s.tick <= t.tick GROUP BY ALL""")
cte("changed", ("alh",), """
SELECT a.job, a.tick, coalesce(bool_or(b.executors IS DISTINCT FROM a.executors) FILTER (WHERE a.tick > 1), false) AS changed
FROM alh a LEFT JOIN alh b ON a.job = b.job AND a.component = b.component AND b.tick = a.tick - 1
GROUP BY ALL""")
cte("epochs", ("changed",), """
SELECT job, tick, changed, epoch,
       CAST((SELECT count(*) FROM numbered n WHERE n.job = m.job AND n.epoch = m.epoch AND n.tick <= m.tick
             AND NOT n.changed) AS INTEGER) AS tick_in_epoch
FROM numbered m""")
cte("numbered", ("changed",), """
SELECT c.job, c.tick, c.changed,
       CAST((SELECT count(*) FROM changed p WHERE p.job = c.job AND p.tick <= c.tick AND p.changed) AS INTEGER) AS epoch
FROM changed c""")
CTE["epochs"] = (("numbered",), CTE["epochs"][1])
cte("dense_e", ("dense", "epochs", "alh"), "SELECT d.job, d.component, d.kind, a.executors, d.tick, e.epoch, e.tick_in_epoch, "
    + ", ".join(f"d.{c}" for c in MODEL_COLUMNS)
    + """ FROM dense d JOIN epochs e ON d.job = e.job AND d.tick = e.tick AND NOT e.changed
      JOIN alh a ON d.job = a.job AND d.component = a.component AND d.tick = a.tick""")
cte("hist_e", ("dense_e",), "SELECT a.job, a.component, a.kind, a.executors, a.tick, "
    + ", ".join(f"sum(b.{c}) AS {c}" for c in MODEL_COLUMNS)
    + f""" FROM dense_e a JOIN dense_e b ON a.job = b.job AND a.component = b.component AND a.epoch = b.epoch
      AND b.tick BETWEEN a.tick - {HISTORY - 1} AND a.tick WHERE a.tick_in_epoch >= {HISTORY} GROUP BY ALL""")
cte("src_e", ("hist_e",), f"""
SELECT job, tick, component, {per('s', 'cnt')} AS real_ms, {per('recv_rate_s', 'recv_rate_cnt')} * executors AS external_rate
FROM hist_e WHERE kind = 'source'""")
cte("sv_e", ("hist_e", "src_e"), service_sql("hist_e", "src_e"))
allocation_ctes("epoch", "sv_e", str(2 * BUDGET - 1), "mmk", ("sv_e",))


def check_sql(nodes: str, model: str, budget: int, tag_model: str, tag_qos: str, qos_ms: float = QOS_MS) -> str:
    """CTE bodies for all objectives: ``est`` (context), ``best`` (steps) and ``res`` (rows)."""
    est = f"""
est AS (SELECT job, tick, any_value(real_ms) AS real_ms, bool_and(lam / (mu * executors) < 1) AS stable,
          CAST(sum(executors) AS INTEGER) AS cur,
          sum(CASE WHEN ratio = 0 THEN 0 ELSE {sojourn(model)} * ratio END) * 1000 AS est_ms,
          sum(1 / mu) AS service_s, sum({FLOOR}) AS floor_total
        FROM (SELECT *, executors AS k, {wait('lam', 'mu', 'executors')} AS wait_s FROM {nodes}) GROUP BY ALL),
ctx AS (SELECT *, CASE WHEN est_ms > 0 AND real_ms / est_ms > 1 THEN real_ms / est_ms ELSE 1.0 END AS adj,
          CASE WHEN real_ms <> 0 AND isfinite(est_ms) THEN abs(real_ms - est_ms) * 100 / real_ms END AS err FROM est),
best AS (SELECT c.job, c.tick, min(s.step) AS qos_step FROM ctx c JOIN step_{tag_qos} s ON c.job = s.job AND c.tick = s.tick
         WHERE s.est_s * c.adj <= {qos_ms} / 1000 AND c.service_s * c.adj < {qos_ms} / 1000
           AND s.floor_total + s.step + 1 <= {2 * budget} GROUP BY ALL),
goal AS (SELECT c.job, c.tick, 'current' AS objective, 'm' AS tag, CAST(c.cur - c.floor_total AS BIGINT) AS step FROM ctx c
         UNION ALL SELECT job, tick, 'max', 'm', CAST({budget} - floor_total AS BIGINT) FROM ctx
         UNION ALL SELECT c.job, c.tick, 'min_qos', 'q', b.qos_step FROM ctx c LEFT JOIN best b ON c.job = b.job AND c.tick = b.tick),
loops AS (SELECT 'm' AS tag, * FROM loop_{tag_model} UNION ALL SELECT 'q', * FROM loop_{tag_qos}),
res AS (SELECT n.job, n.tick, n.component, g.objective, CAST(l.k AS INTEGER) AS executors, n.executors AS current,
          CASE WHEN b.qos_step IS NOT NULL THEN 'FEASIBLE' ELSE 'INFEASIBLE' END AS status,
          {r6('c.real_ms', 'real_ms')}, {r6('c.est_ms', 'est_ms')}, {r6('c.adj', 'ratio_real')}, {r6('c.err', 'error_pct')}, c.stable
        FROM {nodes} n JOIN ctx c ON n.job = c.job AND n.tick = c.tick
        JOIN goal g ON n.job = g.job AND n.tick = g.tick
        LEFT JOIN best b ON n.job = b.job AND n.tick = b.tick
        LEFT JOIN loops l ON l.job = n.job AND l.tick = n.tick AND l.component = n.component AND l.tag = g.tag AND l.step = g.step)"""
    return est


def checked(needs: tuple[str, ...], tail: str, body: str) -> str:
    head = with_ctes(needs, "")
    return head.rstrip() + "," + tail + "\n" + body


RES_COLUMNS = "job, tick, component, objective, executors, current, status, real_ms, est_ms, ratio_real, error_pct, stable"


def full_sql(history: str) -> str:
    """Whole-job allocation: services as suggested, sources as they are."""
    return f"""
SELECT {RES_COLUMNS} FROM res
UNION ALL
SELECT h.job, h.tick, h.component, r.objective, CASE WHEN r.known THEN h.executors END, h.executors, r.status,
       r.real_ms, r.est_ms, r.ratio_real, r.error_pct, r.stable
FROM {history} h JOIN (SELECT job, tick, objective, bool_and(executors IS NOT NULL) AS known, any_value(status) AS status,
    any_value(real_ms) AS real_ms, any_value(est_ms) AS est_ms, any_value(ratio_real) AS ratio_real,
    any_value(error_pct) AS error_pct, bool_and(stable) AS stable FROM res GROUP BY ALL) r
  ON h.job = r.job AND h.tick = r.tick WHERE h.kind = 'source'"""


ORACLES: dict[str, str] = {}


def oracle(name: str, needs: tuple[str, ...], body: str) -> None:
    ORACLES[name] = with_ctes(needs, body) if needs else body


# --- points ---
QS = "recv_rate, recv_capacity, recv_population, recv_sojourn, send_rate, send_capacity, send_population, send_sojourn".split(", ")
cte("mp", ("td", "er"), """
SELECT job, day AS ts, component, task, CASE WHEN kind = 'source' THEN 'complete-latency' ELSE 'execute' END AS name,
       CAST(NULL AS DOUBLE) AS num, count(*) AS kvn FROM td GROUP BY job, day, component, kind, task
UNION ALL SELECT job, day, component, task, 'emit', NULL, count(*) FROM td GROUP BY job, day, component, task
UNION ALL SELECT DISTINCT job, day, component, task, 'junk', 1.0, NULL FROM td
UNION ALL SELECT DISTINCT job, day, component, task, 'latency-stat', NULL, 0 FROM td
UNION ALL SELECT DISTINCT job, day, component, task, 'miss-qos', NULL, NULL FROM td
UNION ALL SELECT job, day, component, executor, '__receive', NULL, 4 FROM er
UNION ALL SELECT job, day, component, executor, '__sendqueue', NULL, 4 FROM er
UNION ALL SELECT job, day, component, executor, 'duration', duration_ms, NULL FROM er
UNION ALL SELECT job, day, '__acker', executor, '__receive', NULL, 4 FROM er""")
cte("alias", (), """
SELECT * FROM (VALUES ('__sendqueue', 'send-queue'), ('__receive', 'recv-queue'), ('complete-latency', 'complete-latency'),
  ('execute', 'execute'), ('emit', 'emit'), ('duration', 'duration'), ('latency-stat', 'latency-stat'),
  ('miss-qos', 'miss-qos')) v(name, alias)""")
cte("lines", (), r"""
SELECT conv_id, turn, CAST(line - 1 AS INTEGER) AS line, value
FROM (SELECT conv_id, turn, unnest(parts) AS value, generate_subscripts(parts, 1) AS line
      FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations))""")
cte("rec", (), "SELECT 's-' || conv_id || '-' || turn AS sid, text AS sentence, conv_id, turn FROM conversations")
NAMES = """
SELECT job, ts, component, task, string_agg(alias, ',' ORDER BY alias) AS names, CAST(count(*) AS INTEGER) AS n_values
FROM mp JOIN alias USING (name)
WHERE component NOT LIKE '\\_\\_%' ESCAPE '\\' AND (num IS NOT NULL OR kvn > 0) GROUP BY ALL""".replace("\\\\", "\\")
oracle("scan_metric_points", ("mp", "alias"), NAMES)
oracle("pivot_points", ("mp", "alias"), NAMES)
CMV_ROWS = "SELECT job, day AS ts, component, task, stream, cnt, round(s, 6) AS s, round(ss, 6) AS ss FROM td WHERE cnt > 0"
oracle("scan_metric_log", ("td",), CMV_ROWS)
oracle("parse_cmv", ("td",), CMV_ROWS)
oracle("sink_metric_log", ("mp", "alias"), f"""
SELECT job, 'task.' || component || '.' || task AS record, count(*) AS lines FROM ({NAMES}) GROUP BY ALL""")
oracle("unknown_tasks", ("mp", "alias"), f"""
SELECT job, ts, component, task, n_values FROM ({NAMES}) WHERE task % 8 >= 6""")
MIXED = """
SELECT '00' || job[4:4] AS job, component, 'task.' || component || '.' || task AS name, sum(arrivals) AS n FROM td GROUP BY job, component, task"""
oracle("scan_other_records", ("td",), f"""
SELECT job, 'topology.info' AS name, '{{"component":"' || component || '"}}' AS body, count(*) AS n FROM ({MIXED}) GROUP BY ALL
UNION ALL SELECT job, 'alloc', 'n=' || n, count(*) FROM ({MIXED}) GROUP BY ALL""")
oracle("scan_rejects", ("td",), f"""
SELECT job, value, count(*) AS n FROM (
  SELECT job, unnest(['task.' || component || '.99999999999->{{}}', name || '->not json', 'no arrow ' || component,
                      name || '->{{"timestamp":9999999999999999}}']) AS value FROM ({MIXED})) GROUP BY ALL""")
oracle("scan_text_queue", ("lines",), "SELECT value AS text, count(*) AS n FROM lines GROUP BY value")
oracle("consume_text_queue", ("lines",), """
SELECT value AS text, count(*) AS n, count(*) AS n_archived, CAST(0 AS BIGINT) AS n_left FROM lines GROUP BY value""")
oracle("scan_peek", ("lines",), f"SELECT * FROM lines ORDER BY conv_id, turn, line LIMIT {PEEK}")
oracle("sink_raw_lines", ("lines",), f"""
SELECT value, count(*) AS n FROM (SELECT value FROM lines ORDER BY conv_id, turn, line LIMIT {RAW}) GROUP BY value""")
oracle("scan_cluster_snapshot", ("ex",), "SELECT * FROM ex")
oracle("parse_approved_names", (), """
SELECT name, arg_max(alias, event_id) AS alias
FROM (SELECT event_id, event_type || (event_id % 7) AS name,
             CASE WHEN event_id % 3 = 0 THEN event_type || (event_id % 7) ELSE 'as' || user_id END AS alias
      FROM events WHERE event_id % 3 < 2) GROUP BY name""")
COUNTS = "SELECT job, component, name, count(*) AS points FROM {} GROUP BY ALL"
oracle("approved_metrics", ("mp", "alias"),
       COUNTS.format("(SELECT job, component, alias AS name FROM mp JOIN alias USING (name))"))
oracle("drop_system_components", ("mp",), COUNTS.format("(SELECT * FROM mp WHERE component[1:2] <> '__')"))
oracle("drop_empty_points", ("mp",), COUNTS.format("(SELECT * FROM mp WHERE num IS NOT NULL OR kvn > 0)"))
oracle("queue_fields", ("td", "er"), "SELECT t.job, t.day AS ts, t.component, t.task, e.duration_ms, "
       + ", ".join(f"round(e.{c}, 6) AS {c}" for c in QS)
       + """ FROM (SELECT DISTINCT job, day, component, task FROM td
              UNION SELECT job, day, component, executor FROM er) t
       LEFT JOIN er e ON t.job = e.job AND t.day = e.day AND t.task = e.executor""")
oracle("sample_one_in_n", ("te",), f"""
SELECT job, task, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job, task ORDER BY ts, event_id) - 1 AS p FROM te)
WHERE p % {SAMPLE_N} = 0""")
oracle("service_key", ("te",), """
SELECT job, component, CASE component WHEN 'click' THEN 'view' WHEN 'error' THEN 'click' WHEN 'purchase' THEN 'error'
         WHEN 'signup' THEN 'purchase' END || ':' || stream AS key,
       count(*) AS cnt, round(sum(ms), 6) AS s, round(sum(ms * ms), 6) AS ss
FROM (SELECT *, trunc(elapsed_ms * 1e6) / 1e6 AS ms FROM te WHERE kind <> 'source') WHERE ms > 0 GROUP BY ALL""")
oracle("positions_in_slices", (), """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY props NULLS FIRST, event_id) - 1 AS position FROM events""")
oracle("assign_sequence_id", (), """
SELECT 's' || task || '-' || (row_number() OVER (PARTITION BY task ORDER BY conv_id, turn) - 1) AS sid, task, conv_id, turn,
       text AS sentence FROM (SELECT *, CAST(conv_id % 8 AS INTEGER) AS task FROM conversations)""")
oracle("tag_lines", ("rec",), "SELECT sid, '+' || sentence AS added, '-' || sentence AS removed FROM rec")
oracle("stamp_lines", (), """
SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) || '|' || (epoch_us(ts) // 1000) || '|' || props AS value FROM events""")
oracle("mark_words", ("rec",), "SELECT sid, sentence || '!!' AS word FROM rec")
oracle("job_name_from_id", ("te",), """
SELECT event_id, job || '-' || component || '-' || (epoch_us(ts) // 1000) AS job_id, job AS job_name FROM te""")
oracle("cmv_format", ("te",), f"""
SELECT job, component,
  format('Count: {{}}, sum: {{:.2f}}, avg: {{:.4f}}, var: {{:.4f}}, scv: {{:.4f}}', cnt, s, s / cnt, ss / cnt - (s / cnt) * (s / cnt), {scv()}) AS long_form,
  format('cnt:{{}},avg:{{:.2f}},scv:{{:.2f}}', cnt, s / cnt, {scv()}) AS short_form
FROM (SELECT job, component, count(*) AS cnt, sum(elapsed_ms) AS s, sum(elapsed_ms * elapsed_ms) AS ss FROM te GROUP BY ALL)""")

# --- joins and metadata ---
oracle("tasks_to_executors", ("tm", "xt"), """
SELECT tm.job, tick, tm.component, tm.task, stream, cnt, x.executor
FROM tm LEFT JOIN (SELECT * FROM xt WHERE executor % 8 < 6) x ON tm.job = x.job AND tm.task = x.task""")
oracle("first_task_only", ("tm", "ex"), """
SELECT job, tick, component, task, stream, cnt, round(s, 6) AS s, round(ss, 6) AS ss FROM tm
WHERE EXISTS (SELECT 1 FROM ex WHERE ex.job = tm.job AND ex.task_start = tm.task)""")
oracle("split_by_kind", ("tm",), f"SELECT job, component, kind AS side, {sums()} FROM tm GROUP BY ALL")
oracle("with_allocation", ("ct", "al"), """
SELECT ct.job, tick, ct.component, executors, CAST(cnt AS BIGINT) AS cnt, round(s, 6) AS s, round(ss, 6) AS ss
FROM ct JOIN al ON ct.job = al.job AND ct.component = al.component""")
oracle("attach_source_rate", ("sv", "src"), f"""
SELECT sv.job, sv.tick, sv.component, {r6('external_rate', 'external_rate')}
FROM sv LEFT JOIN src ON sv.job = src.job AND sv.tick = src.tick""")
oracle("overlay_allocation", ("sv", "al"), f"""
SELECT al.job, t.tick, al.component,
       CASE WHEN al.job <> 'job3' THEN coalesce(sv.lo, al.executors) END AS executors
FROM al JOIN (SELECT DISTINCT job, tick FROM sv) t ON al.job = t.job
LEFT JOIN (SELECT *, {FLOOR} AS lo FROM sv) sv ON sv.job = al.job AND sv.tick = t.tick AND sv.component = al.component""")
oracle("allocation_changed", ("changed",), "SELECT job, tick, changed FROM changed WHERE tick > 1")
oracle("allocation_counts", ("al",), "SELECT job, component, executors FROM al")
oracle("component_tasks", ("xt",), "SELECT job, component, string_agg(task, ',' ORDER BY task) AS tasks FROM xt GROUP BY ALL")
oracle("component_executors", ("ex",), """
SELECT job, component, string_agg(task_start || '-' || task_end, ',' ORDER BY task_start) AS ranges FROM ex GROUP BY ALL""")
oracle("task_hosts", ("xt",), "SELECT job, task, host FROM xt")
oracle("assignment_map", ("ex",), """
SELECT job, component, '[' || task_start || ', ' || task_end || ']' AS executor, host || ':' || port AS place FROM ex""")
oracle("topology_info", ("te", "comp"), """
SELECT c.job, s.sources, s.services, c.component, e.stream, e.target AS targets
FROM comp c JOIN (SELECT job, string_agg(component, ',' ORDER BY component) FILTER (WHERE kind = 'source') AS sources,
                         string_agg(component, ',' ORDER BY component) FILTER (WHERE kind <> 'source') AS services
                  FROM comp GROUP BY job) s ON c.job = s.job
LEFT JOIN (SELECT DISTINCT job, component, stream, CASE component WHEN 'view' THEN 'click' WHEN 'click' THEN 'error'
             WHEN 'error' THEN 'purchase' WHEN 'purchase' THEN 'signup' END AS target FROM te WHERE component <> 'signup') e
  ON c.job = e.job AND c.component = e.component""")
oracle("allocation_totals", ("al",), """
SELECT job, CAST(sum(CASE WHEN kind = 'source' THEN executors ELSE 0 END) AS INTEGER) AS source_executors,
       CAST(sum(CASE WHEN kind <> 'source' THEN executors ELSE 0 END) AS INTEGER) AS service_executors FROM al GROUP BY job""")
EVENT_CMV = "count(*) AS cnt, round(sum(elapsed_ms), 6) AS s, round(sum(elapsed_ms * elapsed_ms), 6) AS ss"
oracle("pick_source", ("te",), f"""
SELECT * FROM (SELECT job, component, {EVENT_CMV} FROM te GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY job ORDER BY component) = 1""")

# --- aggregations ---
WEEK_US = 7 * DAY_US
oracle("cmv_aggregate", (), f"""
SELECT l_returnflag, l_linestatus, make_timestamp((epoch_us(l_shipdate) // {WEEK_US}) * {WEEK_US}) AS bucket,
       count(*) AS cnt, round(sum(l_quantity), 6) AS s, round(sum(l_quantity * l_quantity), 6) AS ss
FROM lineitem GROUP BY ALL""")
oracle("cmv_merge", ("tm",), f"SELECT job, component, {sums()} FROM tm GROUP BY ALL")
oracle("cmv_stats", ("te",), f"""
SELECT job, component, stream, cnt, round(s, 6) AS s, round(ss, 6) AS ss, round(s / cnt, 6) AS avg, round(ss / cnt, 6) AS avg2,
       round(ss / cnt - (s / cnt) * (s / cnt), 6) AS var, round({scv()}, 6) AS scv
FROM (SELECT job, component, stream, count(*) AS cnt, sum(elapsed_ms) AS s, sum(elapsed_ms * elapsed_ms) AS ss FROM te GROUP BY ALL)""")
# every executor, one idle one per component included, at every tick of its job
cte("xf", ("ex", "comp", "tm"), f"""
SELECT e.job, e.component, e.executor, CAST(unnest(range(1, last + 1)) AS INTEGER) AS tick
FROM (SELECT job, component, task_start AS executor FROM ex
      UNION ALL SELECT job, component, CAST(({INDEX}) * 8 + 1000 + 8 AS INTEGER) FROM comp) e
JOIN (SELECT job, max(tick) AS last FROM tm GROUP BY job) l ON e.job = l.job""")
oracle("executor_rollup", ("tm", "xt", "xf"), f"""
SELECT e.job, e.tick, e.component, e.executor, r.stream, coalesce(r.cnt, 0) AS cnt, coalesce(r.s, 0.0) AS s, coalesce(r.ss, 0.0) AS ss
FROM xf e
LEFT JOIN (SELECT tm.job, tick, xt.executor, stream, {sums('tm.')}
           FROM tm JOIN xt ON tm.job = xt.job AND tm.task = xt.task GROUP BY ALL) r
  ON e.job = r.job AND e.executor = r.executor AND e.tick = r.tick""")
# a tick may hold several reports of an executor: the first one covers two days
oracle("executor_results", ("xf", "er"), "SELECT e.job, e.tick, e.component, e.executor, coalesce(sum(cnt), 0)::BIGINT AS cnt, "
       "round(coalesce(sum(s), 0.0), 6) AS s, round(coalesce(sum(ss), 0.0), 6) AS ss, coalesce(sum(duration_ms), 0.0) AS duration_ms, "
       + ", ".join(f"count({c}) AS {c}_cnt, round(coalesce(sum({c}), 0.0), 8) AS {c}_s, "
                   f"round(coalesce(sum({c} * {c}), 0.0), 8) AS {c}_ss" for c in QS)
       + " FROM xf e LEFT JOIN er r ON e.job = r.job AND e.executor = r.executor AND e.tick = r.tick"
         " GROUP BY e.job, e.tick, e.component, e.executor")
oracle("component_rollup", ("tm",), f"SELECT job, tick, component, stream, {sums()} FROM tm GROUP BY ALL")
oracle("queue_aggregate", ("er",), "SELECT job, tick, component, "
       + ", ".join(f"count({c}) AS {c}_cnt, round(sum({c}), 8) AS {c}_s, round(sum({c} * {c}), 8) AS {c}_ss" for c in QS)
       + " FROM er GROUP BY ALL")
oracle("duration_sum", ("er",), "SELECT job, tick, component, sum(duration_ms) / 1000.0 AS duration_seconds FROM er GROUP BY ALL")
oracle("stream_combine", ("tm",), f"""
SELECT job, component, stream, {sums()} FROM tm GROUP BY ALL
UNION ALL SELECT job, component, NULL, {sums()} FROM tm GROUP BY ALL""")
oracle("history_rollup", ("hist_all",), """
SELECT job, tick, component, CAST(cnt AS BIGINT) AS cnt, round(s, 6) AS s, round(ss, 6) AS ss, round(duration_ms, 6) AS duration_ms,
       CAST(recv_rate_cnt AS BIGINT) AS recv_rate_cnt, round(recv_rate_s, 6) AS recv_rate_s,
       CAST(send_population_cnt AS BIGINT) AS send_population_cnt, round(send_population_s, 6) AS send_population_s FROM hist_all""")


def bins(value: str, cast: bool = True) -> list[str]:
    edges = [None, *CUTS, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        cond = [f"{value} IS NOT NULL"]
        if low is not None:
            cond.append(f"{value} > {low}")
        if high is not None:
            cond.append(f"{value} <= {high}")
        out.append(f"count(*) FILTER (WHERE {' AND '.join(cond)})")
    return out


oracle("latency_histogram", (), "SELECT l_returnflag || l_linestatus AS key, "
       + ", ".join(f"{b} AS bin{i}" for i, b in enumerate(bins("l_quantity"))) + " FROM lineitem GROUP BY ALL")
DONE = "(CASE WHEN outcome <> 'fail' THEN elapsed_ms END)"
oracle("latency_histogram_text", ("te",), f"""
SELECT job, component, stream, date_trunc('day', ts)::TIMESTAMP AS bucket,
       CASE WHEN count({DONE}) > 0 THEN concat_ws(',', {', '.join(bins(DONE))}) || '|' || count(*) FILTER (WHERE outcome = 'fail') END AS histogram,
       count(*) FILTER (WHERE outcome = 'fail') AS fails
FROM te GROUP BY ALL""")
oracle("qos_miss", ("te",), f"""
SELECT job, component, stream, {EVENT_CMV} FROM te
WHERE outcome = 'ok' AND elapsed_ms > CASE WHEN kind = 'source' THEN 800 ELSE 100 END GROUP BY ALL""")
oracle("emit_count", ("te",), f"""
SELECT job, component, stream, date_trunc('day', ts)::TIMESTAMP AS bucket, CAST(sum(event_id % 3) AS BIGINT) AS emitted
FROM (SELECT *, row_number() OVER (PARTITION BY job, task ORDER BY ts, event_id) - 1 AS p FROM te) WHERE p % {SAMPLE_N} = 0
GROUP BY ALL HAVING sum(event_id % 3) > 0""")

COMPLETED = "(CASE WHEN kind = 'source' AND outcome = 'ok' THEN elapsed_ms END)"
MISSED = "(CASE WHEN kind = 'source' AND outcome = 'ok' AND elapsed_ms > 800 THEN elapsed_ms END)"
oracle("measure_events", ("te",), f"""
SELECT job, date_trunc('day', ts)::TIMESTAMP AS bucket, component, task, stream, count(x) AS cnt,
       round(coalesce(sum(x), 0), 6) AS s, round(coalesce(sum(x * x), 0), 6) AS ss, count(*) AS emitted,
       count({MISSED}) AS miss_cnt, round(coalesce(sum({MISSED}), 0), 6) AS miss_s,
       round(coalesce(sum({MISSED} * {MISSED}), 0), 6) AS miss_ss,
       count(*) FILTER (WHERE kind = 'source' AND outcome = 'fail') AS fails,
       {', '.join(f'{b} AS bin{i}' for i, b in enumerate(bins(COMPLETED)))}
FROM te GROUP BY ALL""")

# --- timeline ---
oracle("tumbling_bucket", ("te",), """
SELECT job, component, date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS n FROM te GROUP BY ALL""")
oracle("report_duration", ("te",), f"""
SELECT job, task, ts, (epoch_us(ts) // 1000) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY job, task ORDER BY ts), {T0})) // 1000 AS duration_ms
FROM (SELECT job, task, date_trunc('day', ts) AS d, max(ts) AS ts FROM te GROUP BY ALL)""")
oracle("optimise_tick", ("te",), f"SELECT job, {tick('ts')} AS tick, count(*) AS n FROM te GROUP BY ALL")
oracle("history_window", ("tm",), f"""
SELECT a.job, a.task, a.tick, min(b.tick) AS oldest_tick, count(*) AS ticks_held
FROM (SELECT DISTINCT job, task, tick FROM tm) a JOIN (SELECT DISTINCT job, task, tick FROM tm) b
  ON a.job = b.job AND a.task = b.task AND b.tick BETWEEN a.tick - {HISTORY - 1} AND a.tick GROUP BY ALL""")
oracle("warmup_gate", ("tm",), f"SELECT DISTINCT job, component, tick FROM tm WHERE 1 + tick >= {HISTORY}")
oracle("unallocated_totals", ("ct", "snap"), """
SELECT c.job, c.tick, c.component, CAST(c.cnt AS BIGINT) AS cnt
FROM ct c LEFT JOIN (SELECT c.job, c.tick, max(s.tick) AS at FROM (SELECT DISTINCT job, tick FROM ct) c JOIN snap s
                     ON s.job = c.job AND s.tick <= c.tick AND s.tick >= 3 GROUP BY ALL) l ON c.job = l.job AND c.tick = l.tick
LEFT JOIN snap s ON s.job = c.job AND s.component = c.component AND s.tick = l.at AND NOT (s.job = 'job1' AND s.component = 'error')
WHERE s.job IS NULL""")
oracle("allocation_epoch", ("epochs",), "SELECT * FROM epochs")
oracle("adjust_gate", ("tm",), "SELECT DISTINCT job, tick FROM tm WHERE (tick + 1)::BIGINT * 86400000 >= 6::BIGINT * 86400000 - 50")

# --- dataflow ---
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
SPLIT = f"SELECT sid, sentence, CASE WHEN {HASH.format(chr(39).join(['sid || ', ':0', '']))} / 4294967296.0 < {PATH_P} THEN 'P-Stream' ELSE 'NotP-Stream' END AS stream FROM rec"
cte("routed", ("rec",), SPLIT)
oracle("split_stream", ("routed",), "SELECT * FROM routed")
oracle("named_outputs", ("rec",), """
SELECT sid, 'long' AS stream, sentence || '+' AS word FROM rec WHERE length(sentence) > 60
UNION ALL SELECT sid, 'even', '-' || substr(sentence, 1, 10) FROM rec WHERE length(sentence) % 2 = 0""")
oracle("merge_streams", ("routed",), """
SELECT sid, CASE WHEN stream = 'P-Stream' THEN 'P:' ELSE '' END || sentence AS sentence, stream FROM routed""")
oracle("shuffle_grouping", ("rec",), "SELECT sid, sentence FROM rec")
# the loop itself, pass by pass
cte("loop0", ("rec",), f"SELECT sid, sentence, ({HASH.format(chr(39).join(['sid || ', ':loop', '']))} + 0.5) / 4294967296.0 AS u FROM rec")
cte("looping", ("loop0",), f"""
SELECT sid, sentence AS word, u, 1 AS passes FROM loop0
UNION ALL SELECT sid, word || '!', u, passes + 1 FROM looping WHERE u < pow({LOOP_P}, passes)""")
cte("finished", ("looping",), f"SELECT sid, word, CAST(passes AS INTEGER) AS passes FROM looping WHERE u >= pow({LOOP_P}, passes)")
oracle("loop_through", ("finished", "rec"), """
SELECT f.sid, r.sentence || array_to_string(list_transform(range(1, f.passes + 1), lambda i: ':' || i), '') AS word, f.passes
FROM finished f JOIN rec r ON f.sid = r.sid""")
oracle("loop_back", ("finished",), "SELECT * FROM finished")
oracle("dataflow_chain", ("rec",), "SELECT sid, sentence || '!!' AS word FROM rec")
oracle("dataflow_two_path", ("routed",), """
SELECT sid, sentence || CASE WHEN stream = 'P-Stream' THEN '+' ELSE '-' END || '!!' AS word, stream,
       CASE WHEN stream = 'P-Stream' THEN 'A-P' ELSE 'A-NotP' END AS path FROM routed""")
oracle("dataflow_loop", ("finished",), "SELECT sid, word AS word_finished FROM finished")

# --- queueing table ---
oracle("source_nodes", ("src",), "SELECT job, tick, component, executors, completed, "
       + ", ".join(r6(c, c) for c in ("real_ms", "real_scv", "duration_seconds", "complete_rate", "emit_rate", "external_rate",
                                      "send_length", "recv_length"))
       + ", 1.0::DOUBLE AS emit_scv, 1.0::DOUBLE AS external_scv FROM src")
oracle("service_nodes", ("sv",), "SELECT job, tick, component, executors, completed, "
       + ", ".join(r6(c, c) for c in ("lam", "ratio", "service_ms", "cs2", "duration_seconds", "complete_rate",
                                      "send_length", "recv_length"))
       + f", {r11('rho', 'rho')}, round(CASE WHEN mu < 1e308 THEN mu END, 6) AS mu, 1.0::DOUBLE AS ca2 FROM sv")
oracle("utilisation", ("sv",), f"""
SELECT job, tick, component, {r11('lam / (mu * executors)', 'rho_now')}, lam / (mu * executors) < 1 AS stable,
       {r11('lam / mu', 'rho_single')} FROM sv""")
oracle("min_servers", ("sv",), f"SELECT job, tick, component, {FLOOR} AS min_executors FROM sv")
cte("curve", ("sv",), f"""
SELECT n.* EXCLUDE (kk), CAST(kk AS INTEGER) AS k, {wait('n.lam', 'n.mu', 'n.kk')} AS wait_s
FROM (SELECT *, unnest(range(lo, lo + {CURVE_MORE} + 1)) AS kk FROM (SELECT *, {FLOOR} AS lo FROM sv)) n""")
oracle("capacity_curve", ("curve",), f"""
SELECT job, tick, component, k, {r11('lam / (mu * k)', 'rho')}, lam / (mu * k) < 1 AS stable, {r6('wait_s', 'wait_s')} FROM curve""")
oracle("erlang_wait", ("sv",), f"""
SELECT job, tick, component, {r6('a', 'wait_now')}, {r6('b', 'wait_forty')}
FROM (SELECT *, {wait('lam', 'mu', 'executors')} AS a, {wait('lam', 'mu', '40')} AS b FROM sv)""")
for _m in ("mmk", "ggk_simple", "ggk_complex"):
    oracle(f"sojourn_{_m}", ("curve",), f"""
SELECT job, tick, component, k, {r6('soj', 'sojourn_s')} FROM (SELECT *, {sojourn(_m)} AS soj FROM curve)""")
oracle("sojourn_mm1", ("sv",), f"""
SELECT job, tick, component, {r6('1 / nullif(mu - lam / executors, 0)', 'sojourn_s')} FROM sv""")
cte("now", ("sv",), f"SELECT *, executors AS k, {wait('lam', 'mu', 'executors')} AS wait_s FROM sv")
oracle("network_sojourn", ("now",), "\nUNION ALL\n".join(f"""
SELECT job, tick, '{_m}' AS model, {r6('est', 'est_s')}, stable
FROM (SELECT job, tick, sum(CASE WHEN ratio = 0 THEN 0 ELSE {sojourn(_m)} * ratio END) AS est,
             bool_and(lam / (mu * k) < 1) AS stable FROM now GROUP BY ALL)""" for _m in ("mmk", "ggk_simple", "ggk_complex")))
oracle("calibrate", ("now",), f"""
SELECT job, tick, {r6('real_ms', 'real_ms')}, {r6('est_ms', 'est_ms')},
       {r6('CASE WHEN est_ms > 0 AND real_ms / est_ms > 1 THEN real_ms / est_ms ELSE 1.0 END', 'ratio_real')},
       {r6('CASE WHEN real_ms <> 0 AND isfinite(est_ms) THEN abs(real_ms - est_ms) * 100 / real_ms END', 'error_pct')}
FROM (SELECT job, tick, any_value(real_ms) AS real_ms,
             1000 * sum(CASE WHEN ratio = 0 THEN 0 ELSE {sojourn('mmk')} * ratio END) AS est_ms FROM now GROUP BY ALL)""")

# --- allocation ---
oracle("marginal_gain", ("curve",), f"""
SELECT job, tick, component, k, {r6('gain', 'gain')}
FROM (SELECT *, (soj - lead(soj) OVER (PARTITION BY job, tick, component ORDER BY k)) * ratio AS gain
      FROM (SELECT *, {sojourn('mmk')} AS soj FROM curve)) WHERE gain IS NOT NULL""")
oracle("best_gain", ("gain_mmk",), f"""
SELECT job, tick, component, k, {r6('gain', 'gain')} FROM gain_mmk WHERE k = lo AND gain > -1 AND lam > 0
QUALIFY row_number() OVER (PARTITION BY job, tick ORDER BY gain DESC, component) = 1""")
oracle("broken_nodes", ("sv",), f"""
SELECT job, tick, component, lo AS min_executors, CAST(room AS BIGINT) AS room
FROM (SELECT *, {BUDGET} - sum(lo) OVER (PARTITION BY job, tick) AS room FROM (SELECT *, {FLOOR} AS lo FROM sv))
WHERE lo + greatest(room, 0) >= {LONGEST}""")
for _m in ("mmk", "ggk_simple", "ggk_complex"):
    oracle("allocate_greedy" if _m == "mmk" else f"allocate_greedy_{_m}", (f"gain_{_m}", f"loop_{_m}"), f"""
SELECT g.job, g.tick, g.component, g.lo AS min_executors, l.k AS executors
FROM gain_{_m} g LEFT JOIN loop_{_m} l ON g.job = l.job AND g.tick = l.tick AND g.component = l.component
  AND l.step = {BUDGET} - g.floor_total WHERE g.k = g.lo""")
oracle("allocate_min_qos", ("gain_qos", "loop_qos", "step_qos"), f"""
SELECT g.job, g.tick, g.component, g.lo AS min_executors, l.k AS executors
FROM gain_qos g
LEFT JOIN (SELECT s.job, s.tick, min(s.step) AS step FROM step_qos s
           JOIN (SELECT job, tick, sum(1 / mu) AS service_s FROM gain_qos WHERE k = lo GROUP BY ALL) f
             ON s.job = f.job AND s.tick = f.tick
           WHERE s.est_s <= {QOS_MS / 2} / 1000 AND f.service_s < {QOS_MS / 2} / 1000
             AND s.floor_total + s.step + 1 <= {2 * BUDGET} GROUP BY ALL) b ON g.job = b.job AND g.tick = b.tick
LEFT JOIN loop_qos l ON g.job = l.job AND g.tick = l.tick AND g.component = l.component AND l.step = b.step
WHERE g.k = g.lo""")
for _m in ("mmk", "ggk_simple", "ggk_complex"):
    ORACLES["check_optimized" if _m == "mmk" else f"check_optimized_{_m}"] = checked(
        ("sv", f"loop_{_m}", "loop_qos", "step_qos"), check_sql("sv", _m, BUDGET, _m, "qos"),
        f"SELECT {RES_COLUMNS} FROM res",
    )
oracle("max_executors", ("al",), f"""
SELECT job, CAST(greatest(2, ceil(sum(executors) / 3.0)) * 3 AS INTEGER) AS derived_limit, {BUDGET + 4} AS configured_limit
FROM al GROUP BY job""")
oracle("service_budget", ("al", "sv"), f"""
SELECT DISTINCT sv.job, sv.tick, cur AS current_budget, CAST({BUDGET + 4} - src AS INTEGER) AS max_budget
FROM sv JOIN (SELECT job, CAST(sum(CASE WHEN kind = 'source' THEN executors ELSE 0 END) AS INTEGER) AS src,
                     CAST(sum(CASE WHEN kind = 'source' THEN 0 ELSE executors END) AS INTEGER) AS cur FROM al GROUP BY job) t
  ON sv.job = t.job""")
oracle("num_workers", ("al",), "SELECT job, CAST(ceil(sum(executors) / 6.0) AS INTEGER) AS workers FROM al GROUP BY job")
CURRENT = (("sv", "hist", "loop_qos", "step_qos"), check_sql("sv", "mmk", BUDGET, "qos", "qos"))
ORACLES["optimise_current"] = checked(*CURRENT, full_sql("hist"))
ORACLES["optimise_metric_log"] = ORACLES["optimise_current"]
ORACLES["optimise"] = checked(
    ("sv", "hist", "loop_large", "step_large"), check_sql("sv", "mmk", LARGE_BUDGET, "large", "large"), full_sql("hist")
)
ORACLES["optimise_epochs"] = checked(
    ("sv_e", "hist_e", "loop_epoch", "step_epoch"), check_sql("sv_e", "mmk", BUDGET, "epoch", "epoch"), full_sql("hist_e")
)
FULL = f", whole AS ({full_sql('hist')})"
ORACLES["decide"] = checked(CURRENT[0], CURRENT[1] + FULL, """
SELECT CAST(t.adjust_type AS INTEGER) AS adjust_type, job, tick, component, executors
FROM whole JOIN (VALUES (0, 'current'), (1, 'max'), (2, 'min_qos'), (7, 'current')) t(adjust_type, objective) USING (objective)
WHERE executors IS NOT NULL AND (tick + 1)::BIGINT * 86400000 >= 8::BIGINT * 86400000 - 50""")
CHANGES = """
SELECT w.job, w.tick, w.component, w.current AS old_executors, w.executors AS new_executors, p.workers
FROM whole w JOIN (SELECT job, tick, bool_or(executors <> current) AS changed, CAST(ceil(sum(executors) / 6.0) AS INTEGER) AS workers
                   FROM whole WHERE objective = 'max' AND executors IS NOT NULL GROUP BY ALL) p
  ON w.job = p.job AND w.tick = p.tick
WHERE w.objective = 'max' AND w.executors IS NOT NULL AND p.changed AND (w.tick + 1)::BIGINT * 86400000 >= 8::BIGINT * 86400000 - 50"""
ORACLES["rebalance_plan"] = checked(CURRENT[0], CURRENT[1] + FULL, CHANGES)


def _chosen(objective: str, name: str) -> str:
    return (f"string_agg(component || '=' || executors, ',' ORDER BY component) "
            f"FILTER (WHERE objective = '{objective}' AND executors IS NOT NULL) AS {name}")


RECORD = f""", record AS (
SELECT job, tick, any_value(status) AS status, {_chosen('current', 'current')}, {_chosen('max', 'maximum')},
       {_chosen('min_qos', 'min_qos')}, any_value(real_ms) AS real_ms, any_value(est_ms) AS est_ms,
       any_value(ratio_real) AS ratio_real, any_value(error_pct) AS error_pct FROM whole GROUP BY job, tick)"""


def record_sql(source: str, services: str) -> str:
    return f"""
SELECT r.*, s.component AS source, {r6('s.external_rate', 'external_rate')}, v.component, v.executors, {r6('v.lam', 'lam')},
       round(CASE WHEN v.mu < 1e308 THEN v.mu END, 6) AS mu, {r11('v.rho', 'rho')}, {r6('v.ratio', 'ratio')}, {r6('v.service_ms', 'service_ms')}
FROM record r JOIN {source} s ON r.job = s.job AND r.tick = s.tick JOIN {services} v ON r.job = v.job AND r.tick = v.tick"""


ORACLES["alloc_record"] = checked((*CURRENT[0], "src"), CURRENT[1] + FULL + RECORD, record_sql("src", "sv"))
ORACLES["topology_record"] = ORACLES["topology_info"].replace("SELECT c.job, s.sources", "SELECT c.job, c.job AS id, s.sources")

# --- streaming: a finite input is closed at its end, so live results are those of all events ---
oracle("stream_cmv", ("te",), f"""
SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, job, component, task, stream, {EVENT_CMV} FROM te GROUP BY ALL""")
oracle("stream_history", ("te",), f"""
SELECT history_start, history_start + INTERVAL {HISTORY} DAY AS history_end, job, component, {EVENT_CMV}
FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP - to_days(CAST(o AS INTEGER)) AS history_start
      FROM te, range({HISTORY}) r(o)) GROUP BY ALL""")
oracle("stream_stateful_counter", ("te",), f"""
SELECT job, task, event_id, p AS position, p % {SAMPLE_N} = 0 AS sampled
FROM (SELECT *, row_number() OVER (PARTITION BY job, task ORDER BY ts, event_id) - 1 AS p FROM te)""")
ORACLES["stream_optimise"] = ORACLES["optimise_current"]
EPOCHS = ("sv_e", "hist_e", "loop_epoch", "step_epoch")
WHOLE_E = check_sql("sv_e", "mmk", BUDGET, "epoch", "epoch") + f", whole AS ({full_sql('hist_e')})"
# reports that come twice count once, and those of unknown tasks do not count
ORACLES["stream_metric_log"] = ORACLES["optimise_epochs"]
ORACLES["stream_alloc_record"] = checked((*EPOCHS, "src_e"), WHOLE_E + RECORD, record_sql("src_e", "sv_e"))
oracle("stream_unknown_tasks", ("mp", "alias"), f"""
SELECT job, ts, component, CAST(task + 1000 AS INTEGER) AS task, n_values FROM ({NAMES}) WHERE component = 'error'""")
ORACLES["stream_rebalance"] = checked(EPOCHS, WHOLE_E, CHANGES)
