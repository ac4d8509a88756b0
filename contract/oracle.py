"""The same results in plain SQL over the test tables, for DuckDB.

Written from the meaning of each query, not from the Spark jobs.
"""

from __future__ import annotations

from contract.queries import COMMENT_ID, POST_ID, PROFILE, TERMS, USERNAME, VIEWER

TABLES = r"""
users AS (
  SELECT c_custkey + 1 AS id, replace(c_name, '#', '_') AS username,
    lower(replace(c_name, '#', '_')) || '@example.com' AS email,
    c_mktsegment || ' ' || c_custkey AS display_name,
    TIMESTAMP '2023-01-01' + to_microseconds(c_custkey) AS created_at,
    CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '2023-01-01' + to_microseconds(c_custkey + 1000000) END AS confirmed_at
  FROM customer
), posts AS (
  SELECT o_orderkey + 1 AS id, 'Is order ' || o_orderkey || ' ' || o_orderpriority || '?' AS text,
    o_custkey + 1 AS author_id, o_orderdate + to_microseconds(o_orderkey) AS created_at
  FROM orders
), lines AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + 1 AS post_id, l_linenumber,
    min(l_partkey) AS part, min(l_returnflag) AS flag, min(l_shipdate) AS shipped, max(l_quantity) AS quantity
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), comments AS (
  SELECT id, 'Was line ' || l_linenumber || ' of ' || post_id || ' returned ' || flag || '?' AS text, post_id,
    part * 3 // 4 + 1 AS author_id,
    CASE WHEN l_linenumber % 2 = 0 THEN lag(id) OVER (PARTITION BY post_id ORDER BY id) END AS parent_id,
    shipped + to_microseconds(id) AS created_at
  FROM lines
), evt AS (
  SELECT event_id, ts, user_id + 1 AS user_id, event_type, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events
), fc AS (
  SELECT post_id, min(id) AS first_comment FROM comments GROUP BY post_id
), raw_likes AS (
  SELECT event_id + 1 AS id, 'PostLike' AS type, user_id, k + 1 AS message_id, ts AS created_at
  FROM evt WHERE event_type = 'click'
  UNION ALL
  SELECT event_id + 1, 'CommentLike', user_id, first_comment, ts
  FROM evt JOIN fc ON fc.post_id = k + 1 WHERE event_type = 'purchase'
), raw_reposts AS (
  SELECT event_id + 1 AS id, 'PostRepost' AS type, user_id, k + 1 AS message_id, ts AS created_at
  FROM evt WHERE event_type = 'view'
  UNION ALL
  SELECT event_id + 1, 'CommentRepost', user_id, first_comment, ts
  FROM evt JOIN fc ON fc.post_id = k + 1 WHERE event_type = 'error'
), raw_follows AS (
  SELECT event_id + 1 AS id, user_id AS follower_id, k + 1 AS followee_id, ts AS created_at
  FROM evt WHERE event_type = 'signup'
), likes AS (
  SELECT min(id) AS id, type, user_id, message_id, min(created_at) AS created_at
  FROM raw_likes GROUP BY type, user_id, message_id
), authored AS (
  SELECT 'Post' AS kind, id, author_id FROM posts UNION ALL SELECT 'Comment', id, author_id FROM comments
), reposts AS (
  SELECT min(r.id) AS id, r.type, r.user_id, r.message_id, min(r.created_at) AS created_at
  FROM raw_reposts r JOIN authored a ON r.type = a.kind || 'Repost' AND r.message_id = a.id
  WHERE a.author_id <> r.user_id
  GROUP BY r.type, r.user_id, r.message_id
), follows AS (
  SELECT min(id) AS id, follower_id, followee_id, min(created_at) AS created_at
  FROM raw_follows WHERE follower_id <> followee_id GROUP BY follower_id, followee_id
), likes_of AS (
  SELECT type, message_id, count(*) AS n FROM likes GROUP BY type, message_id
), reposts_of AS (
  SELECT type, message_id, count(*) AS n FROM reposts GROUP BY type, message_id
), comments_of AS (
  SELECT 'Post' AS kind, post_id AS id, count(*) AS n FROM comments WHERE parent_id IS NULL GROUP BY post_id
  UNION ALL
  SELECT 'Comment', parent_id, count(*) FROM comments WHERE parent_id IS NOT NULL GROUP BY parent_id
), message AS (
  SELECT 'Post' AS kind, id, text, created_at, author_id, id AS post_id, CAST(NULL AS BIGINT) AS parent_id,
    CAST(NULL AS VARCHAR) AS replying_to
  FROM posts
  UNION ALL
  SELECT 'Comment', c.id, c.text, c.created_at, c.author_id, c.post_id, c.parent_id,
    CASE WHEN up.username IS NULL OR up.username = uo.username THEN uo.username
      ELSE up.username || ',' || uo.username END
  FROM comments c
  JOIN posts o ON o.id = c.post_id
  JOIN users uo ON uo.id = o.author_id
  LEFT JOIN comments p ON p.id = c.parent_id
  LEFT JOIN users up ON up.id = p.author_id
), rated AS MATERIALIZED (
  SELECT m.*, u.username AS author_username, u.display_name AS author_display_name,
    coalesce(l.n, 0) AS like_count, coalesce(r.n, 0) AS repost_count, coalesce(c.n, 0) AS comment_count,
    coalesce(r.n, 0) * 3 + coalesce(l.n, 0) * 2 + coalesce(c.n, 0) AS rating
  FROM message m
  JOIN users u ON u.id = m.author_id
  LEFT JOIN likes_of l ON l.type = m.kind || 'Like' AND l.message_id = m.id
  LEFT JOIN reposts_of r ON r.type = m.kind || 'Repost' AND r.message_id = m.id
  LEFT JOIN comments_of c ON c.kind = m.kind AND c.id = m.id
)
"""

CARD = (
    "id, text, created_at, like_count, repost_count, comment_count, user_liked, user_reposted, user_followed, "
    "replying_to, author_id, author_username, author_display_name"
)


def _card(viewer: int) -> str:
    """Rated messages with the marks of one viewer."""
    return f"""card AS (
  SELECT r.*, l.id IS NOT NULL AS user_liked, p.id IS NOT NULL AS user_reposted, f.id IS NOT NULL AS user_followed
  FROM rated r
  LEFT JOIN likes l ON l.user_id = {viewer} AND l.type = r.kind || 'Like' AND l.message_id = r.id
  LEFT JOIN reposts p ON p.user_id = {viewer} AND p.type = r.kind || 'Repost' AND p.message_id = r.id
  LEFT JOIN follows f ON f.follower_id = {viewer} AND f.followee_id = r.author_id
)"""


def _sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([TABLES.strip(), *ctes]) + "\n" + body


def _on_cards(body: str, viewer: int, *ctes: str) -> str:
    return _sql(body, _card(viewer), *ctes)


def _pattern(term: str) -> str:
    return "'%" + term.replace("%", r"\%").replace("'", "''") + r"%' ESCAPE '\'"


def _search(kind: str, term: str, viewer: int, limit: int) -> str:
    return _on_cards(
        f"""SELECT {CARD}, kind AS post_type, created_at AS post_date, rating FROM card
WHERE kind = '{kind}' AND text ILIKE {_pattern(term)} ORDER BY rating DESC, id DESC LIMIT {limit}""",
        viewer,
    )


def _terms(kind: str, terms: list[str], viewer: int, limit: int) -> str:
    hits = "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS term, {CARD}, rating FROM card WHERE kind = '{kind}' AND text ILIKE {_pattern(t)}"""
        for t in terms
    )
    return _on_cards(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rating DESC, id DESC) AS position
FROM hits) WHERE position <= {limit}""",
        viewer,
        f"hits AS ({hits})",
    )


def _found_users(term: str, viewer: int, limit: int) -> str:
    return f"""SELECT * FROM (
  SELECT u.id, u.username, u.display_name,
    mine.id IS NOT NULL AS current_user_following, theirs.id IS NOT NULL AS following_current_user,
    coalesce(a.n, 0) AS follower_count, coalesce(b.n, 0) AS followed_user_count,
    CAST(CASE WHEN u.id = {viewer} THEN 1000 ELSE 0 END + CASE WHEN mine.id IS NOT NULL THEN 15 ELSE 0 END
      + coalesce(a.n, 0) * 3 + coalesce(b.n, 0) AS BIGINT) AS user_rating
  FROM users u
  LEFT JOIN follows mine ON mine.follower_id = {viewer} AND mine.followee_id = u.id
  LEFT JOIN follows theirs ON theirs.follower_id = u.id AND theirs.followee_id = {viewer}
  LEFT JOIN (SELECT followee_id, count(*) AS n FROM follows GROUP BY followee_id) a ON a.followee_id = u.id
  LEFT JOIN (SELECT follower_id, count(*) AS n FROM follows GROUP BY follower_id) b ON b.follower_id = u.id
  WHERE u.username ILIKE {_pattern(term)} OR u.display_name ILIKE {_pattern(term)}
) ORDER BY user_rating DESC, id DESC LIMIT {limit}"""


def _term_table(*parts: str) -> str:
    return "term AS (SELECT DISTINCT term, '%' || replace(term, '%', '\\%') || '%' AS pattern FROM (" + " UNION ALL ".join(parts) + "))"


MANY_TERMS = _term_table(
    "SELECT 'ORDER ' || c_custkey || ' ' AS term FROM customer",
    "SELECT 'er ' || p_partkey || ' _-' FROM part",
    "SELECT s_suppkey || '% urgent' FROM supplier",
    "SELECT n_name[1] FROM nation",
)
PEOPLE_TERMS = _term_table(
    "SELECT '0' || p_partkey AS term FROM part",
    "SELECT 'machinery ' || s_suppkey FROM supplier",
    "SELECT '_omer_0' || s_suppkey || '%' FROM supplier",
    "SELECT n_name FROM nation",
)


# One term that users, posts and comments all hold.
TOP_TERM = "1"


def _search_top() -> str:
    return _on_cards(
        f"""SELECT 'User' AS kind, id, username AS label, user_rating AS rating FROM ({_found_users(TOP_TERM, VIEWER, 3)})
UNION ALL
SELECT * FROM (SELECT kind, id, text, rating FROM card WHERE kind = 'Post' AND text ILIKE {_pattern(TOP_TERM)}
  ORDER BY rating DESC, id DESC LIMIT 3)
UNION ALL
SELECT * FROM (SELECT kind, id, text, rating FROM card WHERE kind = 'Comment' AND text ILIKE {_pattern(TOP_TERM)}
  ORDER BY rating DESC, id DESC LIMIT 3)""",
        VIEWER,
    )


def _popular(viewer: int, limit: str = "") -> str:
    return _on_cards(
        f"""SELECT {CARD}, CASE kind WHEN 'Post' THEN 'Post' ELSE 'CommentRepost' END AS post_type,
  created_at AS post_date, rating
FROM card WHERE kind = 'Post' OR repost_count > 4
ORDER BY CAST(created_at AS DATE) DESC, rating DESC, id DESC, created_at DESC, post_type {limit}""",
        viewer,
    )


FEED_ORDER = "CAST(post_date AS DATE) DESC, rating DESC, id DESC, post_date DESC, post_type"

HOME_ENTRIES = """entry AS (
  SELECT f.follower_id AS viewer_id, CASE r.type WHEN 'PostRepost' THEN 'Post' ELSE 'Comment' END AS kind,
    r.message_id AS id, r.type AS post_type, r.created_at AS post_date, r.user_id AS reposter_id
  FROM follows f JOIN reposts r ON r.user_id = f.followee_id
  UNION ALL
  SELECT r.user_id, CASE r.type WHEN 'PostRepost' THEN 'Post' ELSE 'Comment' END, r.message_id, r.type,
    r.created_at, r.user_id
  FROM reposts r
  UNION ALL
  SELECT f.follower_id, 'Post', p.id, 'Post', p.created_at, NULL
  FROM follows f JOIN posts p ON p.author_id = f.followee_id
  UNION ALL
  SELECT p.author_id, 'Post', p.id, 'Post', p.created_at, NULL FROM posts p
), newest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY viewer_id, post_type, id ORDER BY post_date DESC, reposter_id) AS rn
    FROM entry
  ) WHERE rn = 1
), home AS (
  SELECT n.viewer_id, r.id, r.text, r.created_at, r.like_count, r.repost_count, r.comment_count,
    l.id IS NOT NULL AS user_liked, p.id IS NOT NULL AS user_reposted, f.id IS NOT NULL AS user_followed,
    r.replying_to, r.author_id, r.author_username, r.author_display_name, n.post_type, n.post_date,
    CASE WHEN n.reposter_id = n.viewer_id THEN 'You' ELSE u.display_name END AS reposted_by,
    u.username AS reposted_by_username, r.rating
  FROM newest n
  JOIN rated r ON r.kind = n.kind AND r.id = n.id
  LEFT JOIN users u ON u.id = n.reposter_id
  LEFT JOIN likes l ON l.user_id = n.viewer_id AND l.type = n.kind || 'Like' AND l.message_id = n.id
  LEFT JOIN reposts p ON p.user_id = n.viewer_id AND p.type = n.kind || 'Repost' AND p.message_id = n.id
  LEFT JOIN follows f ON f.follower_id = n.viewer_id AND f.followee_id = r.author_id
)"""


def _timeline(kind: str, viewer: int, user: int | None) -> str:
    own = "posts" if kind == "Post" else "comments"
    only = "" if kind == "Post" else "WHERE type = 'CommentRepost'"
    columns = CARD.replace("id,", "c.id,", 1).replace("created_at,", "c.created_at,", 1)
    return _on_cards(
        f"""SELECT e.user_id, {columns}, e.post_type, e.post_date,
  CASE WHEN NOT e.reposted THEN NULL WHEN e.user_id = {viewer} THEN 'You' ELSE u.display_name END AS reposted_by,
  CASE WHEN e.reposted THEN u.username END AS reposted_by_username
FROM (
  SELECT user_id, replace(type, 'Repost', '') AS kind, message_id, type AS post_type, created_at AS post_date,
    true AS reposted
  FROM reposts {only}
  UNION ALL
  SELECT author_id, '{kind}', id, '{kind}', created_at, false FROM {own}
) e
JOIN card c ON c.kind = e.kind AND c.id = e.message_id
JOIN users u ON u.id = e.user_id""",
        viewer,
    ) if user is None else f"SELECT * EXCLUDE (user_id) FROM ({_timeline(kind, viewer, None)}) WHERE user_id = {user}"


def _liked(viewer: int) -> str:
    columns = CARD.replace("id,", "c.id,", 1).replace("created_at,", "c.created_at,", 1)
    return _on_cards(
        f"""SELECT l.user_id, {columns}, l.id AS like_id, l.type AS like_type, l.created_at AS liked_at,
  CASE WHEN r.id IS NULL THEN NULL WHEN l.user_id = {viewer} THEN 'You' ELSE u.display_name END AS reposted_by,
  CASE WHEN r.id IS NOT NULL THEN u.username END AS reposted_by_username
FROM likes l
JOIN card c ON l.type = c.kind || 'Like' AND l.message_id = c.id
JOIN users u ON u.id = l.user_id
LEFT JOIN reposts r ON r.user_id = l.user_id AND r.type = c.kind || 'Repost' AND r.message_id = c.id""",
        viewer,
    )


POST_THREADS = f"""SELECT post_id AS thread_id, kind AS show_type, {CARD} FROM card WHERE parent_id IS NULL"""

COMMENT_THREADS = f"""SELECT id AS thread_id, 'OriginalComment' AS show_type, {CARD} FROM card WHERE kind = 'Comment'
UNION ALL
SELECT parent_id, 'OriginalCommentReply', {CARD} FROM card WHERE kind = 'Comment' AND parent_id IS NOT NULL
UNION ALL
SELECT x.id, 'OriginalCommentPost', card.* FROM comments x JOIN (SELECT {CARD} FROM card WHERE kind = 'Post') card
  ON card.id = x.post_id
UNION ALL
SELECT x.id, 'ParentComment', card.* FROM comments x JOIN (SELECT {CARD} FROM card WHERE kind = 'Comment') card
  ON card.id = x.parent_id"""

PLAIN = "id, text, created_at, comment_count, author_id, author_username, author_display_name"


def _user_comments(whose: str = "") -> str:
    """Comments with post and parent, from the base tables and one count of comments each."""

    def named(part: str, message: str, author: str, count: str) -> str:
        fields = {
            "id": f"{message}.id", "text": f"{message}.text", "created_at": f"{message}.created_at",
            "comment_count": f"CASE WHEN {message}.id IS NOT NULL THEN coalesce({count}.n, 0) END",
            "author_id": f"{author}.id", "author_username": f"{author}.username", "author_display_name": f"{author}.display_name",
        }
        return ", ".join(f"{sql} AS {part}_{field}" for field, sql in fields.items())

    return f"""SELECT {named("comment", "c", "cu", "cn")}, {named("post", "o", "ou", "pn")}, {named("parent", "p", "pu", "rn")}
FROM comments c JOIN users cu ON cu.id = c.author_id
JOIN posts o ON o.id = c.post_id JOIN users ou ON ou.id = o.author_id
LEFT JOIN comments p ON p.id = c.parent_id LEFT JOIN users pu ON pu.id = p.author_id
LEFT JOIN comments_of cn ON cn.kind = 'Comment' AND cn.id = c.id
LEFT JOIN comments_of pn ON pn.kind = 'Post' AND pn.id = o.id
LEFT JOIN comments_of rn ON rn.kind = 'Comment' AND rn.id = p.id
{whose}"""


# Messages as details show them: text, comments and author, and whether the viewer follows the author.
PLAIN_MESSAGES = f"""plain AS MATERIALIZED (
  SELECT m.kind, m.id, m.text, m.created_at, coalesce(c.n, 0) AS comment_count, m.author_id, u.username AS author_username,
    u.display_name AS author_display_name, m.post_id, m.parent_id,
    EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = {VIEWER} AND f.followee_id = m.author_id) AS current_user_following
  FROM (SELECT 'Post' AS kind, id, text, created_at, author_id, id AS post_id, NULL AS parent_id FROM posts
    UNION ALL SELECT 'Comment', id, text, created_at, author_id, post_id, parent_id FROM comments) m
  JOIN users u ON u.id = m.author_id
  LEFT JOIN comments_of c ON c.kind = m.kind AND c.id = m.id
), below AS (
  SELECT *, row_number() OVER (PARTITION BY kind_of, owner ORDER BY created_at DESC, id DESC) - 1 AS place,
    count(*) OVER (PARTITION BY kind_of, owner) AS total
  FROM (SELECT *, CASE WHEN parent_id IS NULL THEN 'Post' ELSE 'Comment' END AS kind_of, coalesce(parent_id, post_id) AS owner
    FROM plain WHERE kind = 'Comment')
)"""
PLACES = """CAST(coalesce(b.place // 1000, 0) AS INTEGER) AS part, CAST(coalesce((b.total + 999) // 1000, 0) AS INTEGER) AS parts,
  CAST(b.place % 1000 AS INTEGER) AS position"""


def _shown(alias: str, part: str, marked: bool = False) -> str:
    fields = [*PLAIN.split(", "), *["current_user_following"] * marked]
    return ", ".join(f"{alias}.{field} AS {part}_{field}" for field in fields)


STATS = f"""SELECT u.id, u.username, u.display_name, u.email, u.created_at,
  (SELECT count(*) FROM posts p WHERE p.author_id = u.id) AS post_count,
  (SELECT count(*) FROM follows f WHERE f.follower_id = u.id) AS following_count,
  (SELECT count(*) FROM follows f WHERE f.followee_id = u.id) AS follower_count,
  EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = {VIEWER} AND f.followee_id = u.id) AS current_user_following
FROM users u"""


def _follow_list(mine: str, other: str) -> str:
    return f"""SELECT e.{mine} AS user_id, u.id, u.username, u.display_name, e.created_at AS followed_at,
  EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = u.id AND f.followee_id = {VIEWER}) AS following_current_user,
  EXISTS (SELECT 1 FROM follows f WHERE f.follower_id = {VIEWER} AND f.followee_id = u.id) AS current_user_following
FROM follows e JOIN users u ON u.id = e.{other}"""


def _named_follow_list(mine: str, other: str) -> str:
    return f"""SELECT * EXCLUDE (user_id) FROM ({_follow_list(mine, other)})
WHERE user_id = (SELECT id FROM users WHERE lower(username) = lower('{USERNAME}'))"""


def _linked(edges: str, kind: str, when: str, everybody: bool = False) -> str:
    tag = kind + ("Like" if edges == "likes" else "Repost")
    table = "posts" if kind == "Post" else "comments"
    return _sql(
        f"""SELECT {"e.user_id, " if everybody else ""}m.*, e.created_at AS {when}
FROM {edges} e JOIN {table} m ON m.id = e.message_id
WHERE e.type = '{tag}'{"" if everybody else f" AND e.user_id = {PROFILE}"}"""
    )


BLANK = r"[\s\x0B\x{0085}\p{Z}]*"
TEXT_PROBLEMS = rf"""concat_ws('; ',
  CASE WHEN text IS NULL OR regexp_full_match(text, '{BLANK}') THEN 'Text can''t be blank' END,
  CASE WHEN length(text) > 200 THEN 'Text is too long (maximum is 200 characters)' END,
  CASE WHEN NOT regexp_full_match(text, '{BLANK}') AND (right(text, 1) <> '?' OR contains(text, '!')
    OR contains(text, '¡') OR contains(text, '.')) THEN 'Text must only have questions' END)"""
USER_PROBLEMS = rf"""concat_ws('; ',
  CASE WHEN email IS NULL OR NOT regexp_full_match(email, '[\w\-\.]+@([\w\-]+\.)+[\w\-]{{2,}}')
    THEN 'Email is invalid' END,
  CASE WHEN email IS NULL OR regexp_full_match(email, '{BLANK}') THEN 'Email can''t be blank' END,
  CASE WHEN username IS NULL OR NOT regexp_full_match(username, '[\w\-\.]+') THEN 'Username is invalid' END,
  CASE WHEN username IS NULL OR regexp_full_match(username, '{BLANK}') THEN 'Username can''t be blank' END,
  CASE WHEN length(username) > 50 THEN 'Username is too long (maximum is 50 characters)' END,
  CASE WHEN display_name IS NULL OR regexp_full_match(display_name, '{BLANK}')
    THEN 'Display name can''t be blank' END,
  CASE WHEN length(display_name) > 50 THEN 'Display name is too long (maximum is 50 characters)' END)"""

TEXT_RULES = "'Text can''t be blank', 'Text is too long (maximum is 200 characters)', 'Text must only have questions'"


def _repeated(rule: str, table: str, key: str) -> str:
    return f"""SELECT '{rule}' AS rule, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations
FROM (SELECT count(*) AS n FROM {table} GROUP BY {key} HAVING count(*) > 1)"""


def _missing(rule: str, rows: str, key: str, kind: str, where: str = "true") -> str:
    target = {"User": "(SELECT id FROM users WHERE confirmed_at IS NOT NULL)", "Post": "posts", "Comment": "comments"}
    return f"""SELECT '{rule}' AS rule, count(*) AS violations FROM {rows} x
WHERE {where} AND x.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {target[kind]} y WHERE y.id = x.{key})"""


MISSING = "\nUNION ALL\n".join(
    [
        _missing("Post: Author must exist", "posts", "author_id", "User"),
        _missing("Comment: Author must exist", "comments", "author_id", "User"),
        _missing("Comment: Post must exist", "comments", "post_id", "Post"),
        _missing("Comment: Parent must exist", "comments", "parent_id", "Comment"),
        _missing("Follow: Follower must exist", "raw_follows", "follower_id", "User"),
        _missing("Follow: Followee must exist", "raw_follows", "followee_id", "User"),
        _missing("Like: User must exist", "raw_likes", "user_id", "User"),
        _missing("Like: Post must exist", "raw_likes", "message_id", "Post", "type = 'PostLike'"),
        _missing("Like: Comment must exist", "raw_likes", "message_id", "Comment", "type = 'CommentLike'"),
        _missing("Repost: User must exist", "raw_reposts", "user_id", "User"),
        _missing("Repost: Post must exist", "raw_reposts", "message_id", "Post", "type = 'PostRepost'"),
        _missing("Repost: Comment must exist", "raw_reposts", "message_id", "Comment", "type = 'CommentRepost'"),
    ]
)

# Request batches ---------------------------------------------------------

EVENT_REQUESTS = """request AS (
  SELECT event_id AS seq, CASE WHEN value < 20 THEN 'delete' ELSE 'insert' END AS action,
    event_id + 1 + 1000000000 AS id, user_id, event_type, k, ts AS created_at
  FROM evt
)"""


def _edge_batch(name: str) -> list[str]:
    """Requests, which of them break a rule, and what the rest do in turn."""
    if name == "follows":
        key = "follower_id, followee_id"
        batch = """SELECT seq, action, id, user_id AS follower_id, k + 1 AS followee_id, created_at FROM request"""
        refused = """nullif(concat_ws('; ',
    CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.id = b.follower_id) THEN 'Follower must exist' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.id = b.followee_id) THEN 'Followee must exist' END,
    CASE WHEN follower_id = followee_id THEN 'Cannot follow self' END), '')"""
    else:
        key = "type, user_id, message_id"
        suffix = "Like" if name == "likes" else "Repost"
        batch = f"""SELECT seq, action, id,
    CASE WHEN event_type IN ('click', 'view') THEN 'Post{suffix}' ELSE 'Comment{suffix}' END AS type, user_id,
    CASE WHEN event_type IN ('click', 'view') THEN k + 1 ELSE k * 8 + 1 END AS message_id, created_at
  FROM request"""
        own = (
            "CASE WHEN EXISTS (SELECT 1 FROM authored a WHERE b.type = a.kind || 'Repost' AND a.id = b.message_id"
            " AND a.author_id = b.user_id) THEN 'User cannot repost own content' END"
        )
        refused = f"""nullif(concat_ws('; ',
    CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.id = b.user_id) THEN 'User must exist' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM authored a WHERE b.type = a.kind || '{suffix}' AND a.id = b.message_id)
      THEN replace(b.type, '{suffix}', '') || ' must exist' END{", " + own if name == "reposts" else ""}), '')"""
    single = name[:-1]
    joined = " AND ".join(f"s.{k} = b.{k}" for k in key.split(", "))
    return [
        EVENT_REQUESTS,
        f"batch AS ({batch})",
        f"judged AS (SELECT b.*, CASE WHEN action = 'insert' THEN {refused} END AS refused FROM batch b)",
        f"""turn AS (
  SELECT b.*, lag(b.action) OVER (PARTITION BY {", ".join("b." + k for k in key.split(", "))} ORDER BY b.seq) AS before,
    s.id IS NOT NULL AS stored
  FROM judged b LEFT JOIN {name} s ON {joined} WHERE b.refused IS NULL
)""",
        """settled AS (
  SELECT *, CASE
    WHEN action = 'insert' AND CASE WHEN before IS NULL THEN stored ELSE before = 'insert' END
      THEN '%s already exists'
    WHEN action = 'delete' AND NOT CASE WHEN before IS NULL THEN stored ELSE before = 'insert' END
      THEN 'Unable to find %s reference.' END AS reason
  FROM turn
)"""
        % (single.capitalize(), single),
        f"""applied AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) AS rn FROM settled
    WHERE reason IS NULL) WHERE rn = 1
)""",
    ]


def _edges_after(name: str) -> str:
    key = "follower_id, followee_id" if name == "follows" else "type, user_id, message_id"
    columns = f"id, {key}, created_at"
    joined = " AND ".join(f"a.{k} = t.{k}" for k in key.split(", "))
    return _sql(
        f"""SELECT {columns} FROM {name} t WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE {joined})
UNION ALL SELECT {columns} FROM applied WHERE action = 'insert'""",
        *_edge_batch(name),
    )


def _edge_outcomes(name: str) -> str:
    return _sql(
        "SELECT seq, reason FROM settled UNION ALL SELECT seq, refused FROM judged WHERE refused IS NOT NULL",
        *_edge_batch(name),
    )


NEW_POSTS = f"""batch AS (
  SELECT p_partkey AS seq, p_partkey + 1 + 1000000000 AS id, 'Would you buy a ' || p_name || '?' AS text,
    p_partkey + 1 AS author_id, TIMESTAMP '2024-03-01' + to_microseconds(p_partkey) AS created_at
  FROM part
  UNION ALL
  SELECT doc_id + 1000000000, doc_id + 1 + 2000000000, text, doc_id + 1,
    TIMESTAMP '2024-03-02' + to_microseconds(doc_id)
  FROM documents
), judged AS (
  SELECT *, nullif(concat_ws('; ', nullif({TEXT_PROBLEMS}, ''),
    CASE WHEN author_id NOT IN (SELECT id FROM users) THEN 'Author must exist' END), '') AS reason
  FROM batch
)"""

NEW_COMMENTS = f"""batch AS (
  SELECT event_id AS seq, event_id + 1 + 1000000000 AS id,
    'Is event ' || event_id || ' a ' || event_type || CASE event_type WHEN 'error' THEN '!' ELSE '?' END AS text,
    k + 1 AS post_id, user_id AS author_id,
    CASE event_type WHEN 'click' THEN k * 8 + 1 WHEN 'purchase' THEN (k + 1) * 8 + 1
      WHEN 'signup' THEN k * 8 + 2 END AS parent_id, ts AS created_at
  FROM evt
  UNION ALL
  SELECT CASE level WHEN 4 THEN -event_id - 1 ELSE event_id + level * 1000000000 END, event_id + 1 + level * 1000000000,
    'Is ' || event_id || ' at level ' || level || '?',
    k + 1 + CASE WHEN level = 3 AND event_type = 'purchase' THEN 1 ELSE 0 END, user_id,
    event_id + 1 + (level - 1) * 1000000000, ts
  FROM evt, (SELECT unnest([2, 3, 4]::BIGINT[]) AS level)
), own AS (
  SELECT b.*, concat_ws('; ', nullif({TEXT_PROBLEMS.replace("text", "b.text")}, ''),
    CASE WHEN b.author_id NOT IN (SELECT id FROM users) THEN 'Author must exist' END,
    CASE WHEN b.post_id NOT IN (SELECT id FROM posts) THEN 'Post must exist' END) AS problems, p.post_id AS stored_post_id
  FROM batch b LEFT JOIN comments p ON p.id = b.parent_id
), accepted1 AS (
  SELECT id, post_id, seq FROM own WHERE problems = '' AND (parent_id IS NULL OR stored_post_id = post_id)
), accepted2 AS (
  SELECT o.id, o.post_id, o.seq FROM own o JOIN accepted1 a ON a.id = o.parent_id
  WHERE o.problems = '' AND a.seq < o.seq AND a.post_id = o.post_id
), accepted3 AS (
  SELECT o.id, o.post_id, o.seq FROM own o JOIN accepted2 a ON a.id = o.parent_id
  WHERE o.problems = '' AND a.seq < o.seq AND a.post_id = o.post_id
), accepted AS (
  SELECT * FROM accepted1 UNION ALL SELECT * FROM accepted2 UNION ALL SELECT * FROM accepted3
), judged AS (
  SELECT o.*, nullif(concat_ws('; ', nullif(problems, ''),
    CASE WHEN o.parent_id IS NOT NULL AND coalesce(stored_post_id, a.post_id) IS NULL THEN 'Parent must exist' END,
    CASE WHEN coalesce(stored_post_id, a.post_id) <> o.post_id
      THEN 'Reply and parent comment must be to the same post' END), '') AS reason
  FROM own o LEFT JOIN accepted a ON a.id = o.parent_id AND a.seq < o.seq
)"""


def _edits(kind: str) -> str:
    table = "posts" if kind == "Post" else "comments"
    batch = (
        """SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN o_custkey + 2 ELSE o_custkey + 1 END AS actor_id,
    o_orderkey + 1 AS id, CASE o_orderstatus WHEN 'P' THEN 'Order ' || o_orderkey || ' is pending.'
      ELSE 'Was order ' || o_orderkey || ' changed?' END AS text
  FROM orders
  UNION ALL
  SELECT p_partkey + 1000000000, p_partkey + 1, p_partkey + 1000000000, 'Is ' || p_name || ' lost?' FROM part"""
        if kind == "Post"
        else """SELECT id AS seq, part * 3 // 4 + 1 + CASE flag WHEN 'R' THEN 0 ELSE 1 END AS actor_id, id,
    'Was it ' || CAST(quantity AS BIGINT) || CASE WHEN quantity > 45 THEN '.' ELSE '' END || '?' AS text
  FROM lines"""
    )
    return f"""batch AS ({batch}), judged AS (
  SELECT b.*, CASE WHEN t.id IS NULL THEN 'Unable to find {kind} at given ID: ' || b.id
    WHEN t.author_id <> b.actor_id THEN 'Cannot update other''s {table}.'
    ELSE nullif({TEXT_PROBLEMS.replace("text", "b.text")}, '') END AS reason
  FROM batch b LEFT JOIN {table} t ON t.id = b.id
)"""


def _edited(kind: str) -> str:
    table = "posts" if kind == "Post" else "comments"
    return _sql(
        f"""SELECT t.* REPLACE (coalesce(j.text, t.text) AS text)
FROM {table} t LEFT JOIN judged j ON j.id = t.id AND j.reason IS NULL""",
        _edits(kind),
    )


SIGN_UPS = """asked AS (
  SELECT s_suppkey AS seq, replace(s_name, '#', '_') AS username, 'supplier' || s_nationkey || '@example.com' AS email,
    s_name AS display_name
  FROM supplier
  UNION ALL
  SELECT n_nationkey + 1000000000, n_name, 'Nation' || n_nationkey || '@Example.com', n_name FROM nation
  UNION ALL
  SELECT p_partkey + 2000000000, p_name, 'part' || p_partkey || '@example', ' ' FROM part
  UNION ALL
  SELECT c_custkey + 3000000000, upper(replace(c_name, '#', '_')), 'again' || c_custkey || '@example.com',
    'Again ' || c_custkey
  FROM customer
), sign_up AS (
  SELECT seq, seq + 1 + 1000000000 AS id, username, email, display_name,
    TIMESTAMP '2024-03-01' + to_microseconds(seq) AS created_at
  FROM asked
)"""

# Among the valid new users of this batch no username repeats, so the first of
# those that share an email is accepted.
NEW_USERS = f"""{SIGN_UPS}, checked AS (
  SELECT s.*, nullif(concat_ws('; ', nullif({USER_PROBLEMS}, ''),
    CASE WHEN lower(username) IN (SELECT lower(username) FROM users) THEN 'Username has already been taken' END,
    CASE WHEN lower(email) IN (SELECT lower(email) FROM users) THEN 'Email has already been taken' END), '') AS first_reason
  FROM sign_up s
), judged AS (
  SELECT *, CASE WHEN first_reason IS NOT NULL THEN first_reason
    WHEN row_number() OVER (PARTITION BY first_reason IS NULL, lower(email) ORDER BY seq) > 1
      THEN 'Email has already been taken' END AS reason
  FROM checked
)"""

USER_EDITS = f"""batch AS (
  SELECT c_custkey AS seq, CASE WHEN c_acctbal < 0 THEN c_custkey + 2 ELSE c_custkey + 1 END AS actor_id,
    c_custkey + 1 AS id,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) || ' ' || c_custkey END AS new_display_name,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'User' || c_nationkey || '@example.com'
      WHEN 'FURNITURE' THEN 'customer_' || c_custkey || '@example' END AS new_email
  FROM customer
), wanted AS (
  SELECT b.*, u.username, coalesce(b.new_email, u.email) AS email,
    coalesce(b.new_display_name, u.display_name) AS display_name
  FROM batch b JOIN users u ON u.id = b.id
), checked AS (
  SELECT *, CASE WHEN actor_id <> id THEN 'This account is inaccessible'
    ELSE nullif(concat_ws('; ', nullif({USER_PROBLEMS}, ''),
      CASE WHEN EXISTS (SELECT 1 FROM users o WHERE lower(o.email) = lower(new_email) AND o.id <> wanted.id)
        THEN 'Email has already been taken' END), '') END AS first_reason
  FROM wanted
), judged AS (
  SELECT *, CASE WHEN first_reason IS NULL AND new_email IS NOT NULL
      AND row_number() OVER (PARTITION BY first_reason IS NULL, lower(new_email) ORDER BY seq) > 1
    THEN 'Email has already been taken' ELSE first_reason END AS reason
  FROM checked
)"""

# Email changes one after the other: the state of a step is who holds the emails that have
# changed hands (0: nobody), and the email of the users who have moved.
MOVES = """moves AS (
  SELECT c_custkey AS seq, CASE WHEN c_acctbal < 0 THEN c_custkey + 2 ELSE c_custkey + 1 END AS actor_id, c_custkey + 1 AS id,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'Moved' || c_custkey || '@example.com'
      ELSE 'customer_' || lpad(CAST(c_custkey - 1 AS VARCHAR), 9, '0') || '@example.com' END AS email
  FROM customer
  UNION ALL
  SELECT c_custkey + 1000000000, c_custkey + 1, c_custkey + 1,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'customer_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '@example.com'
      ELSE 'shared' || c_nationkey || '@example.com' END
  FROM customer
), step AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, m.actor_id, m.id, lower(m.email) AS email, lower(u.email) AS own, h.id AS holder
  FROM moves m JOIN users u ON u.id = m.id LEFT JOIN users h ON lower(h.email) = lower(m.email)
), sweep(n, seq, id, email, ok, holders, mine) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), '', false, MAP([''], [CAST(0 AS BIGINT)]), MAP([CAST(0 AS BIGINT)], [''])
  UNION ALL
  SELECT n, seq, id, email, ok,
    CASE WHEN NOT ok THEN holders WHEN before = email THEN map_concat(holders, MAP([email], [id]))
      ELSE map_concat(holders, MAP([before, email], [CAST(0 AS BIGINT), id])) END,
    CASE WHEN ok THEN map_concat(mine, MAP([id], [email])) ELSE mine END
  FROM (SELECT s.n, s.seq, s.id, s.email, w.holders, w.mine, coalesce(map_extract(w.mine, s.id)[1], s.own) AS before,
      s.actor_id = s.id AND coalesce(map_extract(w.holders, s.email)[1], s.holder, 0) IN (0, s.id) AS ok
    FROM sweep w JOIN step s ON s.n = w.n + 1)
), moved AS (
  SELECT id, max_by(email, seq) AS email FROM sweep WHERE ok GROUP BY id
)"""

# Sign-ups one after the other: the state of a step is the names that are taken.
CONTEST = f"""sign_up AS (
  SELECT c_custkey AS seq, c_custkey + 1 + 1000000000 AS id, 'Rival' || (c_custkey // 2) AS username,
    'rival' || ((c_custkey + 1) // 2) || '@Example.com' AS email,
    CASE c_mktsegment WHEN 'BUILDING' THEN ' ' ELSE 'Rival' END AS display_name,
    TIMESTAMP '2024-03-01' + to_microseconds(c_custkey) AS created_at
  FROM customer
), step AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, lower(username) AS name, lower(email) AS email,
    nullif({USER_PROBLEMS}, '') AS problems
  FROM sign_up
), sweep(n, seq, reason, names, emails) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', [''], ['']
  UNION ALL
  SELECT n, seq, reason, CASE WHEN reason IS NULL THEN list_append(names, name) ELSE names END,
    CASE WHEN reason IS NULL THEN list_append(emails, email) ELSE emails END
  FROM (SELECT s.n, s.seq, s.name, s.email, w.names, w.emails, nullif(concat_ws('; ', s.problems,
      CASE WHEN list_contains(w.names, s.name) THEN 'Username has already been taken' END,
      CASE WHEN list_contains(w.emails, s.email) THEN 'Email has already been taken' END), '') AS reason
    FROM sweep w JOIN step s ON s.n = w.n + 1)
)"""

POST_DELETIONS = """asked AS (
  SELECT CASE o_orderstatus WHEN 'O' THEN o_custkey + 1 ELSE o_custkey + 2 END AS actor_id, o_orderkey + 1 AS id
  FROM orders
  UNION ALL
  SELECT p_partkey + 1, p_partkey + 1000000000 FROM part
)"""


def _remaining(users: str, posts: str, comments: str) -> str:
    """Ids left when the given frames of ids are deleted with all below them."""
    gone = "(SELECT kind, id FROM gone)"
    return _sql(
        f"""SELECT 'users' AS "table", id FROM users WHERE id NOT IN (SELECT id FROM gone_users)
UNION ALL SELECT 'posts', id FROM posts WHERE ('Post', id) NOT IN {gone}
UNION ALL SELECT 'comments', id FROM comments WHERE ('Comment', id) NOT IN {gone}
UNION ALL SELECT 'likes', id FROM likes WHERE (replace(type, 'Like', ''), message_id) NOT IN {gone}
  AND user_id NOT IN (SELECT id FROM gone_users)
UNION ALL SELECT 'reposts', id FROM reposts WHERE (replace(type, 'Repost', ''), message_id) NOT IN {gone}
  AND user_id NOT IN (SELECT id FROM gone_users)
UNION ALL SELECT 'follows', id FROM follows WHERE follower_id NOT IN (SELECT id FROM gone_users)
  AND followee_id NOT IN (SELECT id FROM gone_users)""",
        POST_DELETIONS,
        f"gone_users AS ({users})",
        f"gone_posts AS ({posts} UNION SELECT id FROM posts WHERE author_id IN (SELECT id FROM gone_users))",
        f"""gone_comments AS (
  SELECT id FROM ({comments}
    UNION SELECT id FROM comments WHERE author_id IN (SELECT id FROM gone_users)
    UNION SELECT id FROM comments WHERE parent_id IS NULL AND post_id IN (SELECT id FROM gone_posts))
  UNION
  SELECT c.id FROM comments c JOIN gone_comments g ON c.parent_id = g.id
)""",
        "gone AS (SELECT 'Post' AS kind, id FROM gone_posts UNION ALL SELECT 'Comment', id FROM gone_comments)",
        recursive=True,
    )


NOBODY = "SELECT id FROM users WHERE false"

ORACLE: dict[str, str] = {
    "message_counts": _sql("SELECT kind, id, like_count, repost_count, comment_count, rating FROM rated"),
    "user_counts": _sql(f"SELECT id, post_count, following_count, follower_count FROM ({STATS})"),
    "search_posts": _search("Post", "urgent", VIEWER, 100),
    "search_posts_anonymous": _search("Post", "urgent", 0, 100),
    "search_posts_limit": _search("Post", "urgent", VIEWER, 2),
    "search_posts_wildcards": _terms("Post", TERMS, VIEWER, 100),
    "search_comments": _search("Comment", "RETURNED r", VIEWER, 100),
    "search_users": _sql(_found_users("0001", VIEWER, 100)),
    "search_users_self": _sql(_found_users("0001", PROFILE, 100)),
    "search_top": _search_top(),
    "search_quick": _sql(_found_users("0001", VIEWER, 6)),
    "search_terms_batch": _terms("Post", TERMS, VIEWER, 3),
    "search_many_terms": _on_cards(
        f"""SELECT term, position, {CARD}, rating FROM (
  SELECT t.term, card.*, row_number() OVER (PARTITION BY t.term ORDER BY rating DESC, card.id DESC) AS position
  FROM term t JOIN card ON card.kind = 'Post' AND card.text ILIKE t.pattern ESCAPE '\\') WHERE position <= 3""",
        VIEWER,
        MANY_TERMS,
    ),
    "search_users_terms": _sql(
        f"""SELECT * FROM (
  SELECT t.term, u.*, row_number() OVER (PARTITION BY t.term ORDER BY user_rating DESC, u.id DESC) AS position
  FROM term t JOIN ({_found_users("", VIEWER, 10**9)}) u
    ON u.username ILIKE t.pattern ESCAPE '\\' OR u.display_name ILIKE t.pattern ESCAPE '\\') WHERE position <= 3""",
        PEOPLE_TERMS,
    ),
    "search_comment_terms_batch": _terms("Comment", ["returned r", "line 2"], VIEWER, 3),
    "popular_feed": _popular(VIEWER),
    "popular_feed_anonymous": _popular(0),
    "popular_feed_limit": _popular(VIEWER, "LIMIT 50"),
    "home_feed": _sql(f"SELECT * EXCLUDE (viewer_id) FROM home WHERE viewer_id = {VIEWER}", HOME_ENTRIES),
    "home_feed_all_rows": _sql(
        f"SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY {FEED_ORDER}) AS position FROM home", HOME_ENTRIES
    ),
    "nested_threads": _on_cards(
        """SELECT post_id AS thread_id, CAST((n - 1) // 1000 AS INT) AS part, CAST((total + 999) // 1000 AS INT) AS parts,
  CAST((n - 1) % 1000 AS INT) AS position, id, author_id, author_username
FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY created_at DESC, id DESC) AS n,
    count(*) OVER (PARTITION BY post_id) AS total
  FROM card WHERE kind = 'Comment' AND parent_id IS NULL)""",
        VIEWER,
    ),
    "home_feed_all": _sql(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY {FEED_ORDER}) AS position
FROM home) WHERE position <= 20""",
        HOME_ENTRIES,
    ),
    "profile_posts": _timeline("Post", VIEWER, PROFILE),
    "profile_posts_self": _timeline("Post", PROFILE, PROFILE),
    "profile_posts_all": _timeline("Post", VIEWER, None),
    "profile_comments": _timeline("Comment", VIEWER, PROFILE),
    "profile_comments_all": _timeline("Comment", VIEWER, None),
    "liked_messages": f"SELECT * EXCLUDE (user_id) FROM ({_liked(VIEWER)}) WHERE user_id = {PROFILE}",
    "liked_messages_all": _liked(VIEWER),
    "post_thread": _on_cards(
        f"SELECT * EXCLUDE (thread_id) FROM ({POST_THREADS}) WHERE thread_id = {POST_ID}", VIEWER
    ),
    "post_threads_all": _on_cards(POST_THREADS, VIEWER),
    "comment_thread": _on_cards(
        f"SELECT * EXCLUDE (thread_id) FROM ({COMMENT_THREADS}) WHERE thread_id = {COMMENT_ID}", VIEWER
    ),
    "comment_threads_all": _on_cards(COMMENT_THREADS, VIEWER),
    "post_list": _sql(f"SELECT {PLAIN} FROM rated WHERE kind = 'Post'"),
    "author_posts": _sql(f"SELECT {PLAIN} FROM rated WHERE kind = 'Post' AND author_id = {PROFILE}"),
    "post_detail": _on_cards(
        f"""SELECT kind AS part, {PLAIN}, CASE WHEN kind = 'Post' THEN user_followed END AS current_user_following
FROM card WHERE post_id = {POST_ID} AND parent_id IS NULL""",
        VIEWER,
    ),
    "comment_detail": _on_cards(
        f"""SELECT show_type AS part, {PLAIN},
  CASE WHEN show_type IN ('OriginalComment', 'OriginalCommentPost') THEN user_followed END AS current_user_following
FROM ({COMMENT_THREADS}) WHERE thread_id = {COMMENT_ID}""",
        VIEWER,
    ),
    "post_detail_nested": _sql(
        f"""SELECT {PLACES}, {_shown("o", "post", True)}, {_shown("b", "comment")}
FROM plain o LEFT JOIN below b ON b.kind_of = 'Post' AND b.owner = o.id WHERE o.kind = 'Post'""",
        PLAIN_MESSAGES,
    ),
    "comment_detail_nested": _sql(
        f"""SELECT {PLACES}, {_shown("c", "comment", True)}, {_shown("o", "post", True)}, {_shown("p", "parent")}, {_shown("b", "reply")}
FROM plain c JOIN plain o ON o.kind = 'Post' AND o.id = c.post_id
LEFT JOIN plain p ON p.kind = 'Comment' AND p.id = c.parent_id
LEFT JOIN below b ON b.kind_of = 'Comment' AND b.owner = c.id WHERE c.kind = 'Comment'""",
        PLAIN_MESSAGES,
    ),
    "user_comments": _sql(_user_comments(f"WHERE c.author_id = {PROFILE}")),
    "user_comments_all": _sql(_user_comments()),
    "user_stats": _sql(f"{STATS} WHERE lower(u.username) = lower('{USERNAME}')"),
    "user_stats_all": _sql(STATS),
    "followed_users": _sql(_named_follow_list("follower_id", "followee_id")),
    "followers": _sql(_named_follow_list("followee_id", "follower_id")),
    "followed_users_all": _sql(_follow_list("follower_id", "followee_id")),
    "followers_all": _sql(_follow_list("followee_id", "follower_id")),
    "liked_posts": _linked("likes", "Post", "liked_at"),
    "liked_comments": _linked("likes", "Comment", "liked_at"),
    "reposted_posts": _linked("reposts", "Post", "reposted_at"),
    "reposted_comments": _linked("reposts", "Comment", "reposted_at"),
    "liked_posts_all": _linked("likes", "Post", "liked_at", everybody=True),
    "liked_comments_all": _linked("likes", "Comment", "liked_at", everybody=True),
    "reposted_posts_all": _linked("reposts", "Post", "reposted_at", everybody=True),
    "reposted_comments_all": _linked("reposts", "Comment", "reposted_at", everybody=True),
    "top_level_comments": _sql("SELECT * FROM comments WHERE parent_id IS NULL"),
    "reply_comments": _sql("SELECT * FROM comments WHERE parent_id IS NOT NULL"),
    "confirmed_users": _sql("SELECT * FROM users WHERE confirmed_at IS NOT NULL"),
    "unconfirmed_users": _sql("SELECT * FROM users WHERE confirmed_at IS NULL"),
    "audit_messages": _sql(
        f"""SELECT rule, count(problems) AS violations FROM (SELECT unnest([{TEXT_RULES}]) AS rule)
LEFT JOIN (SELECT {TEXT_PROBLEMS} AS problems FROM message) ON contains(problems, rule) GROUP BY rule"""
    ),
    "audit_documents": f"""SELECT doc_id, problems FROM (SELECT doc_id, {TEXT_PROBLEMS} AS problems FROM documents)
WHERE problems <> ''""",
    "audit_document_problems": f"""SELECT problem, count(*) AS rows
FROM (SELECT unnest(string_split({TEXT_PROBLEMS}, '; ')) AS problem FROM documents) WHERE problem <> '' GROUP BY problem""",
    "audit_conversations": f"""SELECT conv_id, turn, problems
FROM (SELECT conv_id, turn, {TEXT_PROBLEMS} AS problems FROM conversations) WHERE problems <> ''""",
    "audit_users": f"""WITH {SIGN_UPS}
SELECT id, problems FROM (SELECT id, {USER_PROBLEMS} AS problems FROM sign_up) WHERE problems <> ''""",
    "normalise_users": f"WITH {SIGN_UPS} SELECT id, lower(email) AS email FROM sign_up",
    "audit_unique": _sql(
        "\nUNION ALL\n".join(
            [
                _repeated("Username has already been taken", "users", "lower(username)"),
                _repeated("Email has already been taken", "users", "lower(email)"),
                _repeated("Follow already exists", "raw_follows", "follower_id, followee_id"),
                _repeated("Like already exists", "raw_likes", "type, user_id, message_id"),
                _repeated("Repost already exists", "raw_reposts", "type, user_id, message_id"),
            ]
        )
    ),
    "audit_references": _sql(MISSING),
    "audit_replies": _sql(
        """SELECT 'Reply and parent comment must be to the same post' AS rule, count(*) AS violations
FROM comments c JOIN comments p ON p.id = c.parent_id WHERE p.post_id <> c.post_id"""
    ),
    "audit_replies_crossed": _sql(
        """SELECT 'Reply and parent comment must be to the same post' AS rule, c.id
FROM comments c JOIN comments p ON p.id = c.author_id WHERE p.post_id <> c.post_id"""
    ),
    "audit_self_edges": _sql(
        """SELECT 'Cannot follow self' AS rule, count(*) AS violations FROM raw_follows WHERE follower_id = followee_id
UNION ALL
SELECT 'User cannot repost own content', count(*) FROM raw_reposts r
JOIN authored a ON r.type = a.kind || 'Repost' AND r.message_id = a.id WHERE a.author_id = r.user_id"""
    ),
    **{f"apply_{name}": _edges_after(name) for name in ("follows", "likes", "reposts")},
    **{f"apply_{name}_outcomes": _edge_outcomes(name) for name in ("follows", "likes", "reposts")},
    "create_posts": _sql(
        "SELECT * FROM posts UNION ALL SELECT id, text, author_id, created_at FROM judged WHERE reason IS NULL",
        NEW_POSTS,
    ),
    "create_posts_outcomes": _sql("SELECT seq, reason FROM judged", NEW_POSTS),
    "create_comments": _sql(
        """SELECT * FROM comments
UNION ALL SELECT id, text, post_id, author_id, parent_id, created_at FROM judged WHERE reason IS NULL""",
        NEW_COMMENTS,
    ),
    "create_comments_outcomes": _sql("SELECT seq, reason FROM judged", NEW_COMMENTS),
    "edit_posts": _edited("Post"),
    "edit_posts_outcomes": _sql("SELECT seq, reason FROM judged", _edits("Post")),
    "edit_comments": _edited("Comment"),
    "edit_comments_outcomes": _sql("SELECT seq, reason FROM judged", _edits("Comment")),
    "create_users": _sql(
        """SELECT * FROM users UNION ALL
SELECT id, username, lower(email), display_name, created_at, NULL FROM judged WHERE reason IS NULL""",
        NEW_USERS,
    ),
    "create_users_outcomes": _sql("SELECT seq, reason FROM judged", NEW_USERS),
    "edit_users": _sql(
        """SELECT u.* REPLACE (coalesce(j.new_display_name, u.display_name) AS display_name,
  coalesce(lower(j.new_email), u.email) AS email)
FROM users u LEFT JOIN judged j ON j.id = u.id AND j.reason IS NULL""",
        USER_EDITS,
    ),
    "edit_users_outcomes": _sql("SELECT seq, reason FROM judged", USER_EDITS),
    "edit_users_chained": _sql(
        "SELECT u.* REPLACE (coalesce(m.email, u.email) AS email) FROM users u LEFT JOIN moved m ON m.id = u.id",
        MOVES,
        recursive=True,
    ),
    "edit_users_chained_outcomes": _sql(
        """SELECT s.seq, CASE WHEN s.actor_id <> s.id THEN 'This account is inaccessible'
  WHEN NOT w.ok THEN 'Email has already been taken' END AS reason FROM step s JOIN sweep w ON w.n = s.n""",
        MOVES,
        recursive=True,
    ),
    "create_users_chained": _sql(
        """SELECT * FROM users UNION ALL
SELECT u.id, u.username, lower(u.email), u.display_name, u.created_at, NULL
FROM sign_up u JOIN sweep w ON w.seq = u.seq WHERE w.reason IS NULL""",
        CONTEST,
        recursive=True,
    ),
    "create_users_chained_outcomes": _sql("SELECT seq, reason FROM sweep WHERE n > 0", CONTEST, recursive=True),
    "confirm_users_outcomes": _sql(
        """SELECT c_custkey + 1 AS id, TIMESTAMP '2024-01-01' + to_microseconds(c_custkey) AS confirmed_at, NULL AS reason
FROM customer UNION ALL
SELECT s_suppkey + 1000000000, TIMESTAMP '2024-01-01' + to_microseconds(s_suppkey), 'Unable to confirm user with token'
FROM supplier"""
    ),
    "confirm_users": _sql(
        """SELECT u.* REPLACE (coalesce(confirmed_at, TIMESTAMP '2024-01-01' + to_microseconds(c_custkey)) AS confirmed_at)
FROM users u JOIN customer ON c_custkey + 1 = u.id"""
    ),
    "delete_posts": _remaining(
        NOBODY, "SELECT a.id FROM asked a JOIN posts p ON p.id = a.id AND p.author_id = a.actor_id", NOBODY
    ),
    "delete_post_requests": _sql(
        """SELECT a.actor_id, a.id, CASE WHEN p.id IS NULL THEN 'Unable to find Post at given ID: ' || a.id
  WHEN p.author_id <> a.actor_id THEN 'Cannot delete other''s posts.' END AS reason
FROM asked a LEFT JOIN posts p ON p.id = a.id""",
        POST_DELETIONS,
    ),
    "delete_comment_requests": _sql(
        """SELECT CASE WHEN text LIKE '%R?' THEN author_id ELSE author_id + 1 END AS actor_id, id,
  CASE WHEN text LIKE '%R?' THEN NULL ELSE 'Cannot delete other''s comments.' END AS reason FROM comments"""
    ),
    "delete_comments": _remaining(NOBODY, NOBODY, "SELECT id FROM comments WHERE text LIKE '%R?'"),
    "delete_users": _remaining("SELECT id FROM users WHERE confirmed_at IS NULL", NOBODY, NOBODY),
}
# The same tables, whether a batch rewrites them whole or in place.
IN_PLACE = {
    "follows_in_place": "apply_follows",
    "likes_in_place": "apply_likes",
    "reposts_in_place": "apply_reposts",
    "new_posts_in_place": "create_posts",
    "new_comments_in_place": "create_comments",
    "post_edits_in_place": "edit_posts",
    "comment_edits_in_place": "edit_comments",
}
ORACLE |= {name: ORACLE[whole] for name, whole in IN_PLACE.items()}
