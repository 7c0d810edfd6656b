"""Reachability and ordered traces over edge tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_wins
from .tables import cut, drop, tasks


def reach(edges: DataFrame, roots: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(root, node): all nodes reachable from each root, roots included. edges: (a, b); roots: (root)."""
    return _grown(edges, roots.select("root", F.col("root").alias("node")), ["root"], most_rounds)


def reached(edges: DataFrame, seeds: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node): all nodes reachable from any of the seeds (node), seeds included."""
    return _grown(edges, seeds.select("node"), [], most_rounds)


def _grown(edges: DataFrame, start: DataFrame, keys: list[str], most_rounds: int) -> DataFrame:
    """start (keys, node) and what its nodes reach.

    Semi-naive: only the rows found last are joined to the edges, and rows already known leave by an anti join. The
    frontier is written each round, so the plan stays flat, nothing is computed twice, and cycles end.
    """
    edges = cut(edges.select("a", "b").distinct(), "edges")
    known = frontier = cut(start.distinct(), "reached")
    for _ in range(most_rounds):
        new = frontier.join(edges, frontier["node"] == edges["a"]).select(*keys, F.col("b").alias("node")).distinct()
        frontier = cut(new.join(known, [*keys, "node"], "left_anti"), "reached")
        if frontier.isEmpty():
            drop(edges, frontier)
            return known
        known = known.union(frontier)
    raise RuntimeError(f"reach did not end in {most_rounds} rounds")


def typed_chains(known: DataFrame, links: DataFrame, members: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, type, argument, member): the type of every expression that can be typed, and the member it stands for.

    known: (node, type, argument) to begin with. links: (node, receiver, name, size): node is the member `name` with `size`
    arguments of what receiver is; a null name takes over the receiver's type. members: (type, name, size, rank, result,
    argument, member); the first that fits in size, then the first by rank, counts; a null result is the receiver's argument,
    and an argument of * is the receiver's too.

    Semi-naive: a round joins the nodes typed last to the links that wait for them. A node has one receiver, so it is typed
    once, and the rounds are as many as the longest chain. The links are dealt and sorted by receiver once and kept so; a round
    only moves the nodes typed last.
    """
    links = cut(links, "links")
    dealt = links.repartition(tasks(links.sparkSession, links.count()), "receiver").sortWithinPartitions("receiver").persist(StorageLevel.DISK_ONLY)
    members = cut(members.select(F.col("type").alias("of"), F.col("name").alias("called"), F.col("size").alias("takes"), "rank", "result", F.col("argument").alias("given"), "member"), "members")
    frontier = cut(known.select("node", "type", "argument", F.lit(None).cast("string").alias("member")), "typed")
    parts = [frontier]
    for _ in range(most_rounds):
        held = frontier.select(F.col("node").alias("receiver"), "type", "argument")
        waiting = dealt.hint("merge").join(held, "receiver")
        found = waiting.where("name is not null").join(members, (F.col("type") == F.col("of")) & (F.col("name") == F.col("called")))
        found = first_wins(found.withColumn("other", F.col("size") != F.col("takes")), ["node"], ["other", "rank", "member"])
        found = found.select("node", F.when(F.col("result").isNull(), F.col("argument")).otherwise(F.col("result")).alias("type"), F.when(F.col("result").isNotNull(), F.when(F.col("given") == "*", F.col("argument")).otherwise(F.col("given"))).alias("argument"), "member")
        frontier = cut(found.union(waiting.where("name is null").select("node", "type", "argument", F.lit(None).cast("string"))), "typed")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    else:
        raise RuntimeError(f"chains did not end in {most_rounds} rounds")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    out = cut(whole, "typed")
    dealt.unpersist()
    drop(links, members, frontier, *parts)
    return out


def trace(edges: DataFrame, nodes: DataFrame, roots: DataFrame, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """(messages: root, step, from, to, label, back; ends: root, truncated): each root's depth-first walk of calls.

    edges: (a, b, line), walked by line, then b. nodes: (id, actor, label, answer). A call is a message from actor to actor
    with the callee's label, shown once; a callee is entered at its first call; after what it calls, its answer goes back
    (back is true), if it has one. No call follows once there are `most` messages; truncated tells whether one would have.

    One row a root holds the walk: the nodes entered and where each stands, the messages so far. A round joins all nodes on
    the path to their edges and goes on at the deepest one with a new message, so rounds are as many as messages shown.
    """
    n = nodes.select("id", "actor", "label", "answer")
    caller, callee = n.select(F.col("id").alias("a"), F.col("actor").alias("from")), n.select(F.col("id").alias("b"), F.col("actor").alias("to"), "label", "answer")
    e = edges.select("a", "b", "line").distinct().join(caller, "a").join(callee, "b").withColumn("key", F.to_json(F.struct("from", "to", "label")))
    e = cut(e.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("line", "b"))), "calls")
    kind = edges.schema["a"].dataType.simpleString()
    first = roots.select("root").distinct().select("root", F.expr(f"array(named_struct('level', 0, 'node', cast(root as {kind}), 'at', 0, 'from', cast(null as string), 'to', cast(null as string), 'answer', cast(null as string)))").alias("path"), F.array("root").cast(f"array<{kind}>").alias("entered"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<`from`:string,`to`:string,label:string,back:boolean>>").alias("messages"), F.lit(False).alias("truncated"))
    walk, done = cut(first, "walk"), []
    answer = "case when p.answer is null then array() else array(struct(p.`to` as `from`, p.`from` as `to`, p.answer as label, true as back)) end"
    while not walk.isEmpty():
        stands = walk.select("root", "seen", F.explode("path").alias("p")).select("root", "seen", "p.level", F.col("p.node").alias("a"), "p.at")
        left = stands.join(e, "a").where("nth > at")
        new = F.when(~F.array_contains("seen", F.col("key")), F.struct("nth", "b", "from", "to", "label", "answer", "key"))
        left = left.groupBy("root", "level").agg(F.min(new).alias("next")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("level", "next"))).alias("open"))  # levels of one path
        w = walk.join(left, "root", "left").withColumn("open", F.coalesce("open", F.array().cast(left.schema["open"].dataType)))
        # from the deepest level up: answers go back until a level has something new; once full, any call left means truncated
        up = F.expr(f"""aggregate(reverse(path),
          named_struct('messages', messages, 'truncated', truncated, 'depth', -1),
          (acc, p) -> case when acc.depth >= 0 then acc else named_struct(
            'messages', case when size(acc.messages) < {most} and exists(open, o -> o.level = p.level and o.next is not null) then acc.messages else concat(acc.messages, {answer}) end,
            'truncated', acc.truncated or (size(acc.messages) >= {most} and exists(open, o -> o.level = p.level)),
            'depth', case when size(acc.messages) < {most} and exists(open, o -> o.level = p.level and o.next is not null) then p.level else -1 end) end)""")
        w = w.withColumn("up", up).withColumn("x", F.expr("get(filter(open, o -> o.level = up.depth), 0).next"))
        w = cut(w.select("root", "path", "entered", "seen", "up", "x"), "walk")
        done.append(w.where("x is null").select("root", F.col("up.messages").alias("messages"), F.col("up.truncated").alias("truncated")))
        enters = F.expr("not array_contains(entered, x.b)")
        stay = F.expr("transform(slice(path, 1, up.depth + 1), p -> case when p.level = up.depth then struct(p.level as level, p.node as node, x.nth as at, p.`from` as `from`, p.`to` as `to`, p.answer as answer) else p end)")
        into = F.expr("array(named_struct('level', up.depth + 1, 'node', x.b, 'at', 0, 'from', x.`from`, 'to', x.`to`, 'answer', x.answer))")
        called = F.expr("array(struct(x.`from` as `from`, x.`to` as `to`, x.label as label, false as back))")
        back = F.expr("case when x.answer is null then array() else array(struct(x.`to` as `from`, x.`from` as `to`, x.answer as label, true as back)) end")
        on = w.where("x is not null")
        walk = on.select("root", F.when(enters, F.concat(stay, into)).otherwise(stay).alias("path"), F.when(enters, F.concat("entered", F.array("x.b"))).otherwise(F.col("entered")).alias("entered"), F.concat("seen", F.array("x.key")).alias("seen"), F.when(enters, F.concat("up.messages", called)).otherwise(F.concat("up.messages", called, back)).alias("messages"), F.col("up.truncated").alias("truncated"))
    if not done:
        done = [walk.select("root", "messages", "truncated")]
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    messages = whole.select("root", F.posexplode("messages").alias("at", "m")).select("root", (F.col("at") + 1).cast("long").alias("step"), "m.from", "m.to", "m.label", "m.back")
    return messages, whole.select("root", "truncated")
