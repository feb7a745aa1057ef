"""Queries: session store."""

from pyspark.sql import functions as F

from pulseloom import settings
from pulseloom.operators import sessions as se
from pulseloom.plans.registry import query


@query("ses_01_lookup", "select id, user_id, query from @sessions where id = 77")
def lookup(t):
    return se.listing(t.sessions, ["id"], id=77).select("id", "user_id", "query")


@query("ses_02_user_sessions", "select id, query, epoch(created_at)::bigint as created_s from @sessions where user_id = 769")
def user_sessions(t):
    return se.listing(t.sessions, [F.desc("created_at"), F.col("id")], user_id=769).select(
        "id", "query", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("created_s"))


@query("ses_03_harvest_rows", "select session_id, query, line, result_count from @harvest where platform = 'youtube' and session_id = 7124")
def harvest_rows(t):
    return se.listing(t.harvest, ["collected_at", "line"], session_id=7124, platform="youtube").select("session_id", "query", "line", "result_count")


_STEP = " ".join(f"when stage = '{s}' and status = 'completed' then {i + 1}" for i, s in enumerate(settings.RUN_STAGES))


@query("ses_04_resume_points", f"select session_id, max(case {_STEP} else 0 end) as next_stage from @runs group by session_id")
def resume_points(t):
    return se.resume_points(t.runs)


@query("ses_05_finish_runs", """
    select id, case when status = 'failed' then 'failed' else 'completed' end as status, epoch(started_at)::bigint + 60 as completed_s,
           case when status = 'failed' then 'rate limit' end as error, case when status = 'failed' then null else concat('{"items":', cast(cast(l_quantity as bigint) as string), '}') end as summary from @runs""")
def finish_runs(t):
    r = t.runs
    none = F.lit(None).cast("string")
    running = r.select("id", F.lit("running").alias("status"), F.lit(None).cast("bigint").alias("completed_at"), none.alias("error"), none.alias("result_summary"))
    bad = F.col("status") == "failed"
    summary = F.to_json(F.struct(F.col("l_quantity").cast("bigint").alias("items")))
    outcomes = r.select("id", (F.unix_seconds(F.col("started_at").cast("timestamp")) + 60).alias("completed_at"), F.when(bad, "rate limit").alias("error"),
                        F.when(~bad, summary).alias("result_summary"))
    return se.finish_runs(running, outcomes).withColumnRenamed("completed_at", "completed_s").withColumnRenamed("result_summary", "summary")


@query("ses_06_summary", f"""
    select s.id as session_id, s.query, coalesce(h.items, 0) as items, coalesce(h.platforms, 0) as platforms, coalesce(r.next_stage, 0) as next_stage, coalesce(r.failed, 0) as failed
    from @sessions s
    left join (select session_id, sum(result_count)::bigint as items, count(distinct platform) as platforms from @harvest group by session_id) h on h.session_id = s.id
    left join (select session_id, max(case {_STEP} else 0 end) as next_stage, count(*) filter (where status = 'failed') as failed from @runs group by session_id) r on r.session_id = s.id""")
def summary(t):
    harvest = t.harvest.groupBy("session_id").agg(F.sum("result_count").alias("items"), F.countDistinct("platform").alias("platforms"))
    failed = t.runs.groupBy("session_id").agg(F.count_if(F.col("status") == "failed").alias("failed"))
    base = t.sessions.select(F.col("id").alias("session_id"), "query")
    joined = se.session_summary(base, harvest=harvest, resume=se.resume_points(t.runs), failed=failed)
    return joined.na.fill(0)


@query("ses_07_transcripts", "select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as rank from conversations where role = 'assistant'")
def transcripts(t):
    from pulseloom.operators.ranking import placed
    return placed(t.conversations.filter("role = 'assistant'"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "rank")


@query("ses_08_usage_events", """
    select event_id, session_id, stage, prompt_tokens, output_tokens, coalesce(total_tokens, 0) as total_tokens, 'gemini' as model from @usage where event_id % 10 <> 3 and event_id % 7 <> 2""")
def usage_events(t):
    u = t.usage
    usage = F.when(F.col("event_id") % 7 != 2, F.struct(F.col("prompt_tokens").alias("promptTokenCount"), F.col("output_tokens").alias("candidatesTokenCount"),
                                                      F.col("total_tokens").alias("totalTokenCount")))
    # the session id carries the event id along, so that rows can be told apart
    events = u.select(F.struct("session_id", "event_id").alias("session_id"), F.col("stage").alias("scope"), F.lit(None).cast("string").alias("model"),
                      F.when(F.col("event_id") % 10 == 3, "error").otherwise("ok").alias("phase"), usage.alias("usage"))
    kept = se.usage_events(events)
    return kept.select("session_id.event_id", "session_id.session_id", "stage", "model", "prompt_tokens", "output_tokens", "total_tokens")
