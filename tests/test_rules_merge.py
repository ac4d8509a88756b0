import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from agora.functions import text as rules
from agora.plans import audit, cascade, merge
from agora.schema import COMMENT, POST

AT = datetime(2024, 2, 1)


def problems(spark, values, column):
    frame = spark.createDataFrame([(v,) for v in values], "text string")
    return [r[0] for r in frame.select(column).collect()]


def test_question_rule(spark):
    bad = {
        None: rules.TEXT_BLANK, "": rules.TEXT_BLANK, "  \n": rules.TEXT_BLANK,
        "n" * 200 + "?": rules.TEXT_TOO_LONG, "A statement": rules.TEXT_NOT_QUESTION, "Why? ": rules.TEXT_NOT_QUESTION,
        "Wow! So?": rules.TEXT_NOT_QUESTION, "Wow¡ So?": rules.TEXT_NOT_QUESTION, "Yes. So?": rules.TEXT_NOT_QUESTION,
    }
    assert problems(spark, list(bad), rules.text_problems(F.col("text"))) == [[v] for v in bad.values()]
    good = ["A? B?", "n" * 199 + "?", "Étés ?"]
    assert problems(spark, good, rules.text_problems(F.col("text"))) == [[]] * 3
    both = problems(spark, ["x" * 201], rules.text_problems(F.col("text")))
    assert both == [[rules.TEXT_TOO_LONG, rules.TEXT_NOT_QUESTION]]


def test_email_and_username_formats(spark):
    def ok(values, username, email):
        frame = spark.createDataFrame([(v,) for v in values], "v string")
        return [r[0] == [] for r in frame.select(rules.user_problems(username, email, F.lit("Name"))).collect()]

    # One address for each way to break the rule, then one for each part that may vary.
    bad = ["two words@site.org", "no-at-sign.org", "x@site.o", "x@site", "@site.org", "x@.org", "x@site..org", "x@@site.org",
           "x(y)@site.org", "x@si te.org", "x@site.org ", "x@site.org\n", "", None]
    good = ["x@site.org", "x.y-z_9@site.org", "x@a.b.site.org", "x@my_site.org", "x@site.museum", "x@site.o-r"]
    email = F.col("v")
    assert ok(bad, F.lit("name"), email) == [False] * len(bad)
    assert ok(good, F.lit("name"), email) == [True] * len(good)
    bad = ["n" * 51, "two words", "", None, *[f"name{c}" for c in "<>[]{}=,;:|'"]]
    assert ok(bad, F.col("v"), F.lit("x@site.org")) == [False] * len(bad)
    assert ok(["N.a-m_e9", "n" * 50], F.col("v"), F.lit("x@site.org")) == [True, True]


def test_audits(world):
    a, b = world.user("same"), world.user("SAME", email="x@y.com")
    post, other = world.post(author=a), world.post(author=77)
    comment = world.comment(post, a)
    stray = world.comment(other, b, parent=comment)
    world.follow(a, a), world.follow(a, b), world.follow(a, b)
    own = world.repost("Post", post, a)
    world.like("Comment", 99, a)
    tables = world.tables()
    assert {(r.rule, r.key, r.rows) for r in audit.repeated_keys(tables).collect()} == {
        (audit.USERNAME_TAKEN, "same", 2), (audit.FOLLOW_REPEATED, f"{a}/{b}", 2)
    }
    assert {(r.rule, r.key) for r in audit.missing_references(tables).collect()} == {
        ("Post: Author must exist", 77), ("Like: Comment must exist", 99)
    }
    assert [r.id for r in audit.misplaced_replies(tables).collect()] == [stray]
    assert {(r.rule, r.id) for r in audit.self_edges(tables).collect()} == {
        (audit.FOLLOWS_SELF, 1), (audit.REPOSTS_OWN, own)
    }
    summary = audit.summary(audit.repeated_keys(tables), audit.UNIQUE_RULES).collect()
    assert {r.rule: r.violations for r in summary}[audit.LIKE_REPEATED] == 0


def test_edges_in_turn_match_brute_force(world, spark):
    users = [world.user() for _ in range(4)]
    for x, y in ((1, 2), (2, 3), (3, 1)):
        world.follow(x, y)
    tables = world.tables()
    rng = random.Random(7)
    batch = [
        (seq, rng.choice(["insert", "delete"]), 1000 + seq, rng.choice([*users, 9]), rng.choice(users), AT)
        for seq in range(300)
    ]
    frame = spark.createDataFrame(
        batch, "seq long, action string, id long, follower_id long, followee_id long, created_at timestamp_ntz"
    )
    state = {(r[1], r[2]): r[0] for r in world.rows["follows"]}
    want = {}
    for seq, action, id_, x, y, _ in batch:
        wrong = []
        if action == "insert" and x == 9:
            wrong.append("Follower must exist")
        if action == "insert" and x == y:
            wrong.append(audit.FOLLOWS_SELF)
        if wrong:
            want[seq] = "; ".join(wrong)
        elif action == "insert":
            want[seq] = audit.FOLLOW_REPEATED if (x, y) in state else None
            state.setdefault((x, y), id_)
        else:
            want[seq] = None if state.pop((x, y), None) else merge.NO_EDGE["follows"]
    done = merge.apply_edges(tables, "follows", frame)
    assert {r.seq: r.reason for r in done.outcomes.collect()} == want
    assert {(r.follower_id, r.followee_id): r.id for r in done.table.collect()} == state


def test_messages(world, spark):
    author, other = world.user(), world.user()
    post, elsewhere = world.post(author=author), world.post(author=other)
    parent = world.comment(elsewhere, other)
    tables = world.tables()
    schema = "seq long, id long, text string, post_id long, author_id long, parent_id long, created_at timestamp_ntz"
    batch = [
        (1, 101, "Fine?", post, author, None, AT), (2, 102, "Bad.", post, author, None, AT),
        (3, 103, "Here?", post, author, parent, AT), (4, 104, "There?", elsewhere, author, parent, AT),
        (5, 105, "Who?", 99, 98, None, AT),
    ]
    done = merge.create_comments(tables, spark.createDataFrame(batch, schema))
    assert {r.seq: r.reason for r in done.outcomes.collect()} == {
        1: None, 2: rules.TEXT_NOT_QUESTION, 3: audit.REPLY_ON_OTHER_POST, 4: None,
        5: "Author must exist; Post must exist",
    }
    assert {r.id for r in done.table.collect()} == {parent, 101, 104}
    edits = [(1, author, post, "New?"), (2, other, post, "Mine?"), (3, author, post, "Newer?"), (4, author, post, "No"),
             (5, author, 55, "Lost?")]
    done = merge.edit_messages(tables, POST, spark.createDataFrame(edits, "seq long, actor_id long, id long, text string"))
    assert {r.seq: r.reason for r in done.outcomes.collect()} == {
        1: None, 2: "Cannot update other's posts.", 3: None, 4: rules.TEXT_NOT_QUESTION,
        5: "Unable to find Post at given ID: 55",
    }
    assert {r.id: r.text for r in done.table.collect()} == {post: "Newer?", elsewhere: "Why?"}


def test_users_keep_names_unique_in_turn(world, spark):
    world.user("taken", email="taken@x.com")
    tables = world.tables()
    rng = random.Random(3)
    batch = [(s, 100 + s, f"N{rng.randrange(12)}", f"E{rng.randrange(12)}@x.com", "D", AT) for s in range(40)]
    batch += [(90, 190, "TAKEN", "new@x.com", "D", AT), (91, 191, "fresh", "Taken@X.com", "D", AT)]
    frame = spark.createDataFrame(
        batch, "seq long, id long, username string, email string, display_name string, created_at timestamp_ntz"
    )
    names, emails, accepted = {"taken"}, {"taken@x.com"}, set()
    for seq, _, name, email, *_ in batch:
        if name.lower() not in names and email.lower() not in emails:
            names.add(name.lower()), emails.add(email.lower()), accepted.add(seq)
    done = merge.create_users(tables, frame)
    outcomes = {r.seq: r.reason for r in done.outcomes.collect()}
    assert len(outcomes) == len(batch) and {s for s, reason in outcomes.items() if reason is None} == accepted
    assert {r.id - 100 for r in done.table.collect() if r.id > 1} == accepted
    assert all(r.email == r.email.lower() for r in done.table.collect())


def test_user_edits(world, spark):
    a, b = world.user("a", "A"), world.user("b", "B", confirmed_at=AT)
    tables = world.tables()
    schema = "seq long, actor_id long, id long, display_name string, email string"
    batch = [(1, a, a, "AA", None), (2, b, a, "Hack", None), (3, b, b, None, "A@somewhere.com"),
             (4, b, b, None, "New@x.com"), (5, a, a, None, "new@x.com"), (6, a, a, " ", None)]
    done = merge.edit_users(tables, spark.createDataFrame(batch, schema))
    assert {r.seq: r.reason for r in done.outcomes.collect()} == {
        1: None, 2: merge.OTHER_ACCOUNT, 3: audit.EMAIL_TAKEN, 4: None, 5: audit.EMAIL_TAKEN,
        6: rules.DISPLAY_NAME_BLANK,
    }
    assert {r.id: (r.display_name, r.email) for r in done.table.collect()} == {
        a: ("AA", "a@somewhere.com"), b: ("B", "new@x.com")
    }
    now = datetime(2024, 3, 1)
    confirmed = merge.confirm_users(tables, spark.createDataFrame([(a, now), (b, now)], "id long, confirmed_at timestamp_ntz"))
    assert {r.id: r.confirmed_at for r in confirmed.collect()} == {a: now, b: AT}


def test_cascade(world):
    author = world.user()
    post = world.post(author=author)
    chain = [world.comment(post)]
    for _ in range(12):
        chain.append(world.comment(post, parent=chain[-1]))
    side = world.comment(post, parent=chain[2])
    kept_post = world.post()
    kept = world.comment(kept_post)
    likes = {c: world.like("Comment", c) for c in (*chain, side, kept)}
    post_like = world.like("Post", post)
    tables = world.tables()

    def left(after):
        return {n: {r.id for r in f.select("id").collect()} for n, f in after.items()}

    after = left(cascade.cascade_delete(tables, comments=tables.comments.filter(f"id = {chain[3]}")))
    assert after["comments"] == {*chain[:3], side, kept}
    assert after["likes"] == {likes[c] for c in (*chain[:3], side, kept)} | {post_like}
    after = left(cascade.cascade_delete(tables, posts=tables.posts.filter(f"id = {post}")))
    assert after["comments"] == {kept} and after["posts"] == {kept_post} and after["likes"] == {likes[kept]}
    after = left(cascade.cascade_delete(tables, users=tables.users.filter(f"id = {author}")))
    assert after["posts"] == {kept_post} and author not in after["users"]


def test_cascade_refuses_cycles(world):
    post = world.post()
    a = world.comment(post, parent=2)
    world.comment(post, parent=a)
    root = world.comment(post)
    tables = world.tables()
    with pytest.raises(ValueError, match="cycle"):
        cascade.cascade_delete(tables, comments=tables.comments.filter(f"id = {root}"))


def test_delete_requests(world, spark):
    author = world.user()
    post = world.post(author=author)
    requests = spark.createDataFrame([(author, post), (99, post), (author, 50)], "actor_id long, id long")
    rows = cascade.delete_requests(world.tables(), POST, requests).collect()
    assert {(r.actor_id, r.id): r.reason for r in rows} == {
        (author, post): None, (99, post): "Cannot delete other's posts.",
        (author, 50): "Unable to find Post at given ID: 50",
    }
    assert cascade.OTHERS[COMMENT] == "Cannot delete other's comments."


def test_replies_to_comments_of_the_same_batch(world, spark):
    user, post, other = world.user(), world.post(), world.post()
    stored = world.comment(post, user)
    asked = [  # (id, post, parent, text): in order of seq
        (100, post, None, "A?"), (101, post, 100, "B?"), (102, post, 101, "C?"), (103, post, 102, "D?"),
        (104, post, 106, "Early?"), (105, other, 103, "Elsewhere?"), (106, post, stored, "E?"), (107, post, 105, "F?"),
        (108, post, 103, "no question"), (109, post, 108, "G?"), (110, post, 109, "H?"), (111, post, 999, "I?"),
    ]
    rows = [(k, i, text, p, user, parent, world.now()) for k, (i, p, parent, text) in enumerate(asked)]
    schema = "seq long, id long, text string, post_id long, author_id long, parent_id long, created_at timestamp_ntz"
    merged = merge.create_comments(world.tables(), spark.createDataFrame(rows, schema))
    reasons = {asked[r.seq][0]: r.reason for r in merged.outcomes.collect()}
    assert {i for i in reasons if reasons[i] is None} == {100, 101, 102, 103, 106}
    assert {i for i in reasons if reasons[i] == "Parent must exist"} == {104, 107, 109, 110, 111}
    assert reasons[105] == audit.REPLY_ON_OTHER_POST
    assert {r.id for r in merged.table.collect()} == {stored, 100, 101, 102, 103, 106}
