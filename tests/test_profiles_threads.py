from agora.operators.messages import as_records
from agora.operators.nesting import nest
from agora.plans import lists, people, profiles, threads


def test_profile_posts(world):
    owner, other = world.user("owner", "Owner"), world.user("other", "Other")
    own = world.post(author=owner)
    reposted = world.post(author=other)
    comment = world.comment(reposted, other)
    reply = world.comment(reposted, other, parent=comment)
    world.post(author=other)
    for kind, message in (("Post", reposted), ("Comment", comment), ("Comment", reply)):
        world.repost(kind, message, owner)
    tables = world.tables()
    rows = profiles.profile_posts(tables, owner, other).collect()
    assert [(r.post_type, r.id) for r in rows] == [
        ("CommentRepost", reply), ("CommentRepost", comment), ("PostRepost", reposted), ("Post", own)
    ]
    assert [r.reposted_by for r in rows] == ["Owner"] * 3 + [None]
    assert [r.repost_count for r in rows] == [1, 1, 1, 0]
    assert rows[0].replying_to == ["other"]
    assert [r.reposted_by for r in profiles.profile_posts(tables, owner, owner).collect()] == ["You"] * 3 + [None]
    batch = profiles.profile_posts_all(tables, other).filter(f"user_id = {owner}").drop("user_id")
    assert sorted(batch.collect()) == sorted(rows)


def test_profile_comments_and_likes(world):
    owner = world.user("owner", "Owner")
    post = world.post()
    own = world.comment(post, owner)
    reply = world.comment(post, owner, parent=own)
    noted = world.comment(post)
    world.repost("Comment", noted, owner)
    first, second = world.like("Post", post, owner), world.like("Comment", noted, owner)
    tables = world.tables()
    rows = profiles.profile_comments(tables, owner).collect()
    assert [(r.post_type, r.id) for r in rows] == [("CommentRepost", noted), ("Comment", reply), ("Comment", own)]
    liked = profiles.liked_messages(tables, owner, owner).collect()
    assert [(r.like_id, r.like_type, r.reposted_by) for r in liked] == [
        (second, "CommentLike", "You"), (first, "PostLike", None)
    ]
    assert [r.id for r in profiles.liked_posts(tables, owner).collect()] == [post]
    assert [r.id for r in profiles.reposted_comments(tables, owner).collect()] == [noted]
    assert profiles.reposted_posts(tables, owner).collect() == []


def test_threads(world):
    asker = world.user("asker")
    post = world.post(author=asker)
    first, second = world.comment(post), world.comment(post)
    reply = world.comment(post, parent=first)
    deep = world.comment(post, parent=reply)
    tables = world.tables()
    rows = threads.post_thread(tables, post).collect()
    assert [(r.show_type, r.id) for r in rows] == [("Comment", second), ("Comment", first), ("Post", post)]
    assert [r.comment_count for r in rows] == [0, 1, 2] and rows[0].replying_to == ["asker"]
    rows = {(r.show_type, r.id) for r in threads.comment_thread(tables, reply).collect()}
    assert rows == {
        ("OriginalComment", reply), ("OriginalCommentPost", post),
        ("ParentComment", first), ("OriginalCommentReply", deep),
    }
    assert {r.show_type for r in threads.comment_thread(tables, second).collect()} == {
        "OriginalComment", "OriginalCommentPost"
    }
    assert threads.post_thread(tables, 99).collect() == []
    nested = threads.nested_threads(threads.post_threads_all(tables)).collect()
    assert [(r.thread_id, r.part, r.parts, [c.id for c in r.comments]) for r in nested] == [
        (post, 0, 1, [second, first])
    ]
    record = as_records(threads.post_thread(tables, post)).collect()[-1]
    assert record.author.username == "asker"


def test_details_and_lists(world):
    viewer, author = world.user("viewer"), world.user("author")
    world.follow(viewer, author)
    post = world.post(author=author)
    top = world.comment(post, author)
    reply = world.comment(post, author, parent=top)
    other = world.post()
    tables = world.tables()
    rows = threads.post_detail(tables, post, viewer).collect()
    assert [(r.part, r.id, r.comment_count, r.current_user_following) for r in rows] == [
        ("Post", post, 1, True), ("Comment", top, 1, None)
    ]
    rows = threads.comment_detail(tables, reply, viewer).collect()
    assert {(r.part, r.id) for r in rows} == {
        ("OriginalComment", reply), ("OriginalCommentPost", post), ("ParentComment", top)
    }
    own = threads.user_comments(tables, author).collect()
    assert [(r.comment.id, r.post.id, r.parent and r.parent.id) for r in own] == [(reply, post, top), (top, post, None)]
    assert [r.id for r in lists.post_list(tables).collect()] == [other, post]
    assert [r.id for r in lists.author_posts(tables, author).collect()] == [post]
    assert lists.author_posts(tables, 99).collect() == []
    assert lists.top_level_comments(tables).count() == 1 and lists.reply_comments(tables).count() == 1


def test_people(world):
    star = world.user("Star")
    fans = [world.user(f"fan{i}") for i in range(5)]
    for fan in fans:
        world.follow(fan, star)
    for fan in fans[:2]:
        world.follow(star, fan)
    for _ in range(3):
        world.post(author=star)
    tables = world.tables()
    stats = people.user_stats(tables, "STAR", fans[0]).collect()
    assert [(r.post_count, r.following_count, r.follower_count, r.current_user_following) for r in stats] == [
        (3, 2, 5, True)
    ]
    rows = people.followers(tables, "star", star).collect()
    assert [r.id for r in rows] == fans[::-1]
    assert [r.current_user_following for r in rows] == [False, False, False, True, True]
    assert all(r.following_current_user for r in rows)
    assert [r.id for r in people.followed_users(tables, "star").collect()] == [fans[1], fans[0]]
    assert people.user_stats(tables, "nobody").collect() == []


def test_long_lists_are_nested_in_parts(spark):
    rows = spark.range(50).selectExpr("id % 2 AS owner", "id", "timestamp_seconds(id) AS created_at")
    parts = nest(rows.filter("owner = 0 OR id < 6"), "owner", ["id"], "list", part_rows=10).collect()
    long = sorted((r for r in parts if r.owner == 0), key=lambda r: r.part)
    assert [x.id for r in long for x in r.list] == list(range(48, -1, -2))
    assert [(r.part, len(r.list)) for r in long] == [(0, 10), (1, 10), (2, 5)]
    assert {r.parts for r in parts if r.owner == 0} == {3}
    assert [[x.id for x in r.list] for r in parts if r.owner == 1] == [[5, 3, 1]]


def test_repeated_edges_show_alike_for_few_and_for_many(world, monkeypatch):
    user, other = world.user(), world.user()
    post = world.post(author=other)
    comment = world.comment(post, other)
    for _ in range(2):
        world.repost("Post", post, user), world.repost("Comment", comment, user)
    world.post(author=user)
    tables = world.tables()
    few = profiles.profile_posts(tables, user, other).collect()
    monkeypatch.setattr("agora.operators.pinning.BROADCAST_ROWS", 0)
    many = profiles.profile_posts(tables, user, other).collect()
    assert len(few) == 5
    assert sorted(map(str, few)) == sorted(map(str, many))
