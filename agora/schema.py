"""The data model: six tables and the fixed type tags."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Type tags stored in likes.type and reposts.type, and the
# tags the queries put on their rows.
POST = "Post"
COMMENT = "Comment"
POST_LIKE = "PostLike"
COMMENT_LIKE = "CommentLike"
POST_REPOST = "PostRepost"
COMMENT_REPOST = "CommentRepost"

LIKE_TYPE = {POST: POST_LIKE, COMMENT: COMMENT_LIKE}
REPOST_TYPE = {POST: POST_REPOST, COMMENT: COMMENT_REPOST}

_id = T.LongType()
_ts = T.TimestampNTZType()
_str = T.StringType()


def _fields(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name in ("parent_id", "confirmed_at")) for name, kind in columns])


USERS = _fields(
    ("id", _id), ("username", _str), ("email", _str), ("display_name", _str),
    ("created_at", _ts), ("confirmed_at", _ts),
)
POSTS = _fields(("id", _id), ("text", _str), ("author_id", _id), ("created_at", _ts))
COMMENTS = _fields(
    ("id", _id), ("text", _str), ("post_id", _id), ("author_id", _id),
    ("parent_id", _id), ("created_at", _ts),
)
MESSAGE_EDGES = _fields(("id", _id), ("type", _str), ("user_id", _id), ("message_id", _id), ("created_at", _ts))
FOLLOWS = _fields(("id", _id), ("follower_id", _id), ("followee_id", _id), ("created_at", _ts))

SCHEMAS = {
    "users": USERS,
    "posts": POSTS,
    "comments": COMMENTS,
    "likes": MESSAGE_EDGES,
    "reposts": MESSAGE_EDGES,
    "follows": FOLLOWS,
}


@dataclass(frozen=True)
class Layout:
    """How stored tables are cut into buckets.

    ``frames`` are the tables with their bucket column, ``index`` is the
    (bucket of id, id, post_id) of the comments, which are cut by post, and ``months``
    a copy of the posts by month.
    """

    frames: dict[str, DataFrame]
    index: DataFrame
    buckets: int
    months: DataFrame | None = None

    def knows(self, *names: str) -> bool:
        return all(name in self.frames for name in names)

    def without(self, names: Iterable[str]) -> "Layout":
        months = None if "posts" in names else self.months
        return replace(self, frames={n: f for n, f in self.frames.items() if n not in names}, months=months)


@dataclass(frozen=True)
class GramIndex:
    """A written index (gram, id, bucket) of the texts of one kind of row."""

    frame: DataFrame
    buckets: int


@dataclass(frozen=True)
class Tables:
    """The six tables every query takes.

    Expected of the caller (and checked by ``plans.audit``): unique ids, unique
    edges, existing authors and posts.  ``layout`` is known for tables stored in
    buckets, those that have not been replaced.
    """

    users: DataFrame
    posts: DataFrame
    comments: DataFrame
    likes: DataFrame
    reposts: DataFrame
    follows: DataFrame
    layout: Layout | None = field(default=None, compare=False)

    def with_(self, **frames: DataFrame) -> "Tables":
        return replace(self, layout=self.layout and self.layout.without(frames), **frames)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in SCHEMAS]
