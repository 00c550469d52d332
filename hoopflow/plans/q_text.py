"""Text queries over whole documents, conversations and candidate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoopflow.functions import scalars as S, text as T
from hoopflow.functions.geometry import r4, rnd
from hoopflow.operators import actions as A, dialogue as DG, rationale as RA
from hoopflow.plans.registry import R, cte, query

_NUM = "list_transform(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?'), lambda s: CAST(s AS DOUBLE))"


@query("txt_number_audit", f"""SELECT doc_id, len(nums) AS n_numbers, len(list_filter(nums, lambda n: NOT (abs(n - 2) <= 0.04e0 OR abs(n - 3) <= 0.06e0 OR abs(n - n_chars) <= greatest(0.02e0, n_chars*0.02e0)))) AS n_fabricated,
  regexp_matches(text, '\\(\\s*-?\\d+(\\.\\d+)?\\s*,\\s*-?\\d+(\\.\\d+)?\\s*\\)') OR regexp_matches(text, '(?i)\\b[xy]\\s*=\\s*-?\\d+(\\.\\d+)?') OR regexp_matches(text, '(?i)\\bpixel') AS has_coordinate,
  len(list_intersect(regexp_extract_all(text, '\\w+'), [CAST(n_chars AS VARCHAR)])) > 0 AS leaks_id FROM (SELECT *, {_NUM} AS nums FROM documents)""")
def _(src):
    d = src("documents")
    allowed = F.array(F.lit(2.0), F.lit(3.0), F.col("n_chars").cast("double"))
    return d.select("doc_id", F.size(T.numbers("text")).cast("long").alias("n_numbers"), F.size(T.fabricated("text", allowed)).cast("long").alias("n_fabricated"),
                    T.has_coordinate("text").alias("has_coordinate"), (F.size(T.leaked_ids("text", F.array("n_chars"))) > 0).alias("leaks_id"))


_NOT = {"why": " AND NOT contains(q, 'why not')"}
_ROUTE = " ".join(f"WHEN regexp_matches(q, '{p}'){_NOT.get(n, '')} THEN '{n}'" for n, p in T.ROUTES)
_DIR = " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{n}'" for n, p in T.DIRECTIONS)


cte("o_rank", "SELECT *, row_number() OVER (PARTITION BY state ORDER BY q DESC, ord) AS rnk FROM fx_cands")
# A question is put to the state of its conversation and turn, with one of the first three candidates on screen.
cte("o_asked", f"""SELECT conv_id, turn, role, conv_id + turn AS state, turn % 3 AS shown, CASE {_ROUTE} WHEN regexp_matches(q, '#?\\s*(\\d{{1,2}})') AND regexp_matches(q, 'pass|to\\b') THEN 'pass_to_number' ELSE 'help' END AS intent,
  CASE {_DIR} END AS dir, TRY_CAST(regexp_extract(q, '#?\\s*(\\d{{1,2}})', 1) AS INT) AS num FROM (SELECT *, trim(lower(text)) AS q FROM conversations)""")
cte("o_offer", "SELECT *, rnk - 1 AS place, ['left', 'right', 'middle'][CAST(ord % 3 AS INT) + 1] AS direction, CAST(ord * 7 % 30 AS INT) AS jersey FROM o_rank")
cte("o_reply", """SELECT a.*, s.n, CASE intent WHEN 'best' THEN 0 WHEN 'next' THEN (shown % n + 1) % n WHEN 'why' THEN shown % n WHEN 'pass_to_number' THEN j.place
    WHEN 'DRIVE' THEN coalesce(d.place, k.place) ELSE k.place END AS place FROM o_asked a
  LEFT JOIN (SELECT state, count(*) AS n FROM o_offer GROUP BY state) s ON s.state = a.state
  LEFT JOIN (SELECT state, action, min(place) AS place FROM o_offer GROUP BY ALL) k ON k.state = a.state AND k.action = a.intent
  LEFT JOIN (SELECT state, direction, min(place) AS place FROM o_offer WHERE action = 'DRIVE' GROUP BY ALL) d ON d.state = a.state AND d.direction = a.dir
  LEFT JOIN (SELECT state, jersey, min(place) AS place FROM o_offer WHERE action = 'PASS_TO' GROUP BY ALL) j ON j.state = a.state AND j.jersey = a.num""")


def answers(src):
    """Every question with its route and the candidate that it selects."""
    c = A.rank_actions(src("fx_cands"), ["state"]).withColumns({
        "direction": F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("middle")), (F.col("ord") % 3 + 1).cast("int")), "jersey": (F.col("ord") * 7 % 30).cast("int")})
    asked = src("conversations").withColumns({"state": F.col("conv_id") + F.col("turn"), "shown": F.col("turn") % 3})
    return DG.answer(asked, c, ["state"], "text", "shown")


@query("txt_intent_route", """SELECT r.conv_id, r.turn, r.role, r.intent, r.dir AS direction, r.num AS number, CAST(r.place AS BIGINT) AS place, o.action_id, count(*) AS n
  FROM o_reply r LEFT JOIN o_offer o ON o.state = r.state AND o.place = r.place GROUP BY ALL""")
def _(src):
    # The route leads to an action of the state, not only to a label; the number names the receiver of a pass.
    by = ["conv_id", "turn", "role", "intent", "direction", "number", "place", "action_id"]
    return answers(src).withColumns({"direction": T.direction("text"), "number": T.jersey_number("text")}).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("txt_intent_answer", f"""SELECT r.conv_id, r.turn, r.role, r.intent, CAST(r.place AS BIGINT) AS place, o.action_id, {R('o.q')} AS q, CASE WHEN n IS NULL THEN 'no_play' WHEN intent = 'help' THEN 'help'
  WHEN r.place IS NOT NULL THEN 'chosen' WHEN intent = 'pass_to_number' THEN 'unknown_number' ELSE 'not_legal' END AS outcome
  FROM o_reply r LEFT JOIN o_offer o ON o.state = r.state AND o.place = r.place""")
def _(src):
    return answers(src).select("conv_id", "turn", "role", "intent", "place", "action_id", r4("q").alias("q"), "outcome")


@query("txt_intent_candidates", """SELECT r.state, k.intent, r.action_id FROM (SELECT state, action, action_id, row_number() OVER (PARTITION BY state, action ORDER BY q DESC, ord) AS rn FROM fx_cands) r
  JOIN (SELECT unnest(['SHOOT', 'DRIVE', 'PASS_TO']) AS intent) k ON r.action = k.intent WHERE rn = 1""")
def _(src):
    # The best candidate of each kind a question may ask for.
    c = A.rank_actions(src("fx_cands"), ["state", "action"]).where("rank = 1")
    return c.where(F.col("action").isin("SHOOT", "DRIVE", "PASS_TO")).select("state", F.col("action").alias("intent"), "action_id")


def ranked(src):
    c = src("fx_cands").withColumns({
        "target_name": F.concat(F.lit("P"), F.col("action_id")), "target_zone": F.lit("paint_non_ra"), "target_sep": F.col("open") * 10, "direction": F.lit("left"),
        "zone": F.when(F.col("state") % 3 == 0, "above_break_three_left").otherwise("mid_range_center"), "p": F.col("p")})
    return A.rank_actions(c, ["state"])


def state_rows(src):
    s = src("fx_cands").groupBy("state").agg(F.max("open").alias("o"))
    return s.select("state", F.concat(F.lit("H"), F.translate((F.col("state") % 10).cast("string"), "0123456789", "abcdefghij")).alias("handler_name"),
                    F.when(F.col("state") % 3 == 0, "above_break_three_left").otherwise("mid_range_center").alias("handler_zone"),
                    F.when(F.col("state") % 4 != 0, F.col("o") * 7).alias("handler_sep"), (F.col("state") % 24).cast("double").alias("shot_clock"),
                    F.array(F.col("o") * 10, F.col("o") * 7).alias("seps"), F.array(F.col("state") + 100000, F.col("state") + 200000).alias("player_ids"))


def briefs(src):
    r = ranked(src)
    # Separations the prose may state include those of the top targets.
    tops = r.where("rank <= 2").groupBy("state").agg(F.collect_list("target_sep").alias("_ts"))
    s = state_rows(src).join(tops, "state").withColumn("seps", F.array_union("seps", "_ts")).drop("_ts")
    return RA.briefs(s, r.withColumn("target_name", F.translate("target_name", "0123456789", "abcdefghij")), ["state"], emphasis="attacking the rim")


@query("txt_brief", """SELECT state, max(CASE WHEN rnk = 1 THEN action END) AS rec_action, max(CASE WHEN rnk = 2 THEN action END) AS alt_action FROM o_rank GROUP BY state""")
def _(src):
    return briefs(src).select("state", F.col("rec.action").alias("rec_action"), F.col("alt.action").alias("alt_action"))


_LET = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"


@query("txt_template", f"""SELECT state, CASE action WHEN 'SHOOT' THEN me || ': take the shot, ' || CASE WHEN state % 3 = 0 THEN 'above break three left' ELSE 'mid range center' END
  WHEN 'PASS_TO' THEN me || ': ball to P' || {_LET.format('action_id')} WHEN 'DRIVE' THEN me || ': attack left' ELSE me || ': pull it out and start over' END AS headline, 0 AS n_violations
  FROM (SELECT *, 'H' || {_LET.format('state % 10')} AS me FROM o_rank WHERE rnk = 1)""")
def _(src):
    t = RA.audit(RA.template(briefs(src)))
    return t.select("state", "headline", F.size("violations").alias("n_violations"))


@query("txt_generate_validate", """SELECT state, CASE WHEN state % 2 = 0 AND state % 5 <> 0 THEN 'model' ELSE 'template_fallback' END AS source FROM (SELECT DISTINCT state FROM fx_cands)""")
def _(src):
    b = briefs(src)
    # Supplied prose for even states; every fifth state states a number nobody gave.
    said = F.when(F.col("state") % 5 == 0, F.lit("Worth 987654.25 points.")).otherwise("Clean look for the shooter.")
    g = b.where("state % 2 = 0").select("state", F.lit("Take it").alias("headline"), said.alias("rationale"), F.lit("Some risk.").alias("risk"), F.lit("Swing it.").alias("alternative"))
    return RA.validated(b, g, ["state"]).select("state", "source")


@query("txt_context_prompt", """SELECT state, string_agg(action_id || ': ' || CASE action WHEN 'PASS_TO' THEN 'PASS' WHEN 'SCREEN_WITH' THEN 'SCREEN' WHEN 'DRIVE' THEN 'DRIVE left' ELSE action END || ' (EPV ' || printf('%.2f', floor(q*10)/10) || ')'
  || CASE WHEN rnk = 1 THEN ' [on screen]' ELSE '' END, chr(10) ORDER BY rnk) AS prompt FROM o_rank GROUP BY state""")
def _(src):
    lab = S.action_label("action", "direction", F.floor(F.col("q") * 10) / 10)
    return RA.prompt_lines(ranked(src), ["state"], lab)
