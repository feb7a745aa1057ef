"""Schemas of landed inputs. No production read infers one."""

from __future__ import annotations

REDDIT_POST = ("rank int, fullname string, postId string, title string, body string, permalink string, author string, subreddit string, "
               "score bigint, comments bigint, createdIso string, createdText string, flair string, rawHtml string")
YOUTUBE_VIDEO = ("id string, title string, description string, channelName string, publishedText string, duration string, "
                 "viewsText string, url string, verified boolean, rank int")
HACKERNEWS_POST = ("id string, type string, title string, text string, url string, author string, createdAt string, points bigint, "
                   "comments bigint, tags array<string>, storyId string, parentId string, rank int")
INSTAGRAM_POST = ("pk string, code string, media_type int, username string, full_name string, is_verified boolean, width int, height int, "
                  "caption string, like_count bigint, comment_count bigint, view_count bigint, taken_at bigint, engagement_velocity double, "
                  "url string, rank int, transcript string")
TRENDS_ENTRY = "method string, error string, interestOverTime string, relatedQueries string, relatedTopics string"

PLATFORM_POSTS = {"reddit": REDDIT_POST, "youtube": YOUTUBE_VIDEO, "hackerNews": HACKERNEWS_POST, "instagram": INSTAGRAM_POST}


def struct_of(fields: str) -> str:
    return "struct<" + ", ".join(f.strip().replace(" ", ":", 1) for f in _split(fields)) + ">"


def _split(fields: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(fields):
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            parts.append(fields[start:i])
            start = i + 1
    return parts + [fields[start:]]


COLLECTION_RESULT = "query string, candidateSource string, errors map<string,string>, " + ", ".join(
    f"{name} array<{struct_of(fields)}>" for name, fields in [*PLATFORM_POSTS.items(), ("googleTrends", TRENDS_ENTRY)])
COLLECTION = f"seed string, rateLimitFailures array<map<string,string>>, results array<{struct_of(COLLECTION_RESULT)}>"

SESSION_STORE = {
    "users": "id string, name string, email string, created_at bigint",
    "sessions": "id string, user_id string, query string, created_at bigint, completed_at bigint",
    "topics": "id string, text string, session_id string, source string, created_at bigint",
    "topic_platform_ids": "topic_id string, platform string, platform_id string, hashed_id string",
    "pipeline_runs": "id string, session_id string, stage string, status string, started_at bigint, completed_at bigint, error string, result_summary string",
    "intent_results": "id string, session_id string, query string, result_json string, created_at bigint",
    "expansion_results": "id string, session_id string, seed string, result_json string, candidate_count bigint, created_at bigint",
    "collector_results": "id string, topic_id string, session_id string, platform string, query string, result_json string, result_count bigint, collected_at bigint",
    "python_results": "id string, session_id string, result_json string, created_at bigint",
    "token_usage": "id string, session_id string, stage string, model string, prompt_tokens bigint, output_tokens bigint, total_tokens bigint, created_at bigint",
    "transcripts": "id string, url string, transcript string, created_at bigint",
}
