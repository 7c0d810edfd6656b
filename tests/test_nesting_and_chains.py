"""Deep nesting, call chains and overloads of a small service; the window functions behind them."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import nesting as N
from factloom.plans.facts import Facts

DEEP = "".join(f"f{k}(" for k in range(10)) + "x" + ")" * 10
SHOP = f'''package shop;
import shop.core.Desk;
class Shop {{
    private final Desk desk;
    private final Mailer mailer;
    private final Bus bus;
    private PhaseState phase;

    void chains(Order order) {{
        desk.find(1L).orElseThrow().owner().rename("x");
        this.desk.first().owner.rename("y");
        Desk.make().find(2L);
        var o = desk.first();
        o.total();
        new Order(1).total();
        ((Order) thing).owner();
        helper().total();
        mailer.send("a").toString();
        for (Order each : desk.all()) {{ each.total(); }}
        desk.all().get(0).total();
        inherited();
    }}
    Order helper() {{ return null; }}

    void overloads(Order order, Person p) {{
        desk.put(order);
        desk.put(p, 1);
        desk.put(p, "a");
        desk.put(p, order.owner());
        desk.put(p, desk.first().total());
    }}

    void deep(int n) {{
        if ({DEEP}) {{
            run(() -> {{ run(() -> {{ if (n > (1 + (2))) {{ throw new shop.LateException("late " + {DEEP}, new Other("not me")); }} }}); }});
        }} else throw new EarlyException({DEEP}, "second");
        run(() -> {{
            bus.publish({DEEP}, new Map<String, Sale>(1), new shop.core.SalePaid({DEEP}, (a, b) -> {{ c(); }}));
            Guard.notNull({DEEP}, "no"); Objects.requireNonNull(order.owner().name(), "why"); Assert.isTrue(a > 1 && b);
        }});
        phase = pick({DEEP});
        throw new OddException(n > 1 ? "a" : "b");
    }}
    static class Other {{ void inner() {{ helper(); }} }}
}}
class Base {{ void inherited() {{ }} }}
'''.replace("class Shop {", "class Shop extends Base {")
CORE = '''package shop.core;
class Desk {
    Optional<Order> find(Long id) { return null; }
    Order first() { return null; }
    List<Order> all() { return null; }
    static Desk make() { return null; }
    void put(Order o) { }
    void put(Person p, String s) { }
    void put(Person p, int n) { }
    void put(Person p, Person q) { }
}
class Order { Person owner; Order(int n) { this.phase = PhaseState.NEW; } PhaseState phase; Person owner() { return owner; } int total() { return 1; } }
class Person { void rename(String s) { } String name() { return ""; } }
enum PhaseState { @Deprecated NEW(f(g(h(1, 2), 3), 4)) { int x() { return 1; } }, OLD { void y() { a(1, 2); } }, @Label(value = "x, y") GONE; int a, b; PhaseState() { } }
'''


STOCK = '''package shop;
import shop.core.Desk;
import shop.core.Order;
class Stock {
    private final Desk desk;
    private Set<Order> held;
    private List<Person> x;

    void lambdas(List<Order> given, Optional<Person> one) {
        desk.all().forEach(x -> x.total());
        desk.all().stream().filter(x -> x.owner() != null).sorted().map(y -> y.owner().name()).toList();
        desk.find(1L).map((o) -> { return o.owner(); });
        one.ifPresent(x -> x.name());
        held.stream().findFirst().get().total();
        given.removeIf(x -> desk.all().stream().anyMatch(z -> z.total() > x.owner().size()));
        desk.find(2L).filter(a -> true).orElseThrow().owner();
        for (var each : given) { each.total(); }
        for (var each : held) each.owner();
        held.iterator().next().total();
        x.get(0).name();
        given.map(w -> w.total());
    }
}
'''


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("Shop.java", "main", SHOP), ("Stock.java", "main", STOCK),("core/Desk.java", "main", CORE), ("other/Order.java", "main", "package aaa;\nclass Order { int total() { return 2; } }\n")]
    with Facts(spark.createDataFrame(rows, "file string, source_set string, text string")) as f:
        yield f


def test_chains_and_overloads(facts):
    line = {n: k + 1 for k, text in enumerate(SHOP.split("\n")) for n in [text.strip()]}
    got = {(r.line, r.b) for r in facts.call_edges().where("a like 'shop.Shop#%'").collect()}
    at = lambda text: next(k for n, k in line.items() if n.startswith(text))
    d, o, p = "shop.core.Desk#", "shop.core.Order#", "shop.core.Person#"
    put = {r.line: r.id for r in facts.methods.where("name = 'put'").collect()}
    want = {
        (at("desk.find"), d + "find"), (at("desk.find"), o + "owner"), (at("desk.find"), p + "rename"), (at("this.desk"), d + "first"), (at("this.desk"), p + "rename"), (at("Desk.make"), d + "make"), (at("Desk.make"), d + "find"),
        (at("var o"), d + "first"), (at("o.total"), o + "total"), (at("new Order"), o + "total"), (at("((Order)"), o + "owner"), (at("helper()"), "shop.Shop#helper"), (at("helper()"), o + "total"), (at("mailer"), "external:Mailer#send"),
        (at("for (Order"), d + "all"), (at("for (Order"), o + "total"), (at("desk.all"), d + "all"), (at("desk.all"), o + "total"), (at("inherited"), "shop.Base#inherited"),
        (at("desk.put(order)"), put[7]), (at("desk.put(p, 1)"), put[9]), (at('desk.put(p, "a")'), put[8]), (at("desk.put(p, order.owner())"), put[10]), (at("desk.put(p, order.owner())"), o + "owner"), (at("desk.put(p, desk.first"), put[9]), (at("desk.put(p, desk.first"), d + "first"), (at("desk.put(p, desk.first"), o + "total"),
        (at("bus.publish"), "external:Bus#publish"),
    }
    assert {(n, b) for n, b in got if "Person#name" not in b} == want
    assert {r.b for r in facts.call_edges().where("a = 'shop.Other#inner'").collect()} == {"shop.Shop#helper"}


def test_names_of_lambdas_and_loops(facts):
    all_, find, total, owner, name = "Desk#all", "Desk#find", "Order#total", "Order#owner", "Person#name"
    want = [{all_, total}, {all_, owner, name}, {find, owner}, {name}, {total}, {all_, total, owner}, {find, owner}, {total}, {owner}, {total}, {name}, set()]
    first = next(k for k, text in enumerate(STOCK.split("\n")) if "forEach" in text) + 1
    got = [set() for _ in want]
    for r in facts.call_edges().where("a = 'shop.Stock#lambdas'").collect():
        got[r.line - first].add(r.b.removeprefix("shop.core."))
    assert got == want


def test_depth_changes_nothing(facts):
    thrown = {r.exception_type: (r.message, r.condition) for r in facts.throw_sites().collect()}
    assert thrown == {"LateException": ("late ", "n > (1 + (2))"), "EarlyException": (None, DEEP), "OddException": (None, None)}
    assert [(r.event, r.producers) for r in facts.event_flows().collect()] == [("SalePaid", [f"Shop#deep@{SHOP[: SHOP.index('bus.publish')].count(chr(10)) + 1}"])]
    assert {(r.field, r.constraint, r.detail) for r in facts.guard_checks().collect()} == {("f0()", "required", "no"), ("name()", "required", "why"), ("a > 1 && b", "must hold", None)}
    assert [(r.enum_type, r.states) for r in facts.state_machines().collect()] == [("PhaseState", ["GONE", "NEW", "OLD"])]
    assert {(r.field, r.value, r.method) for r in facts.assignment_sites().collect()} == {("phase", "NEW", None), ("phase", f"pick({DEEP})", "deep")}


def test_partners_of_broken_brackets(spark):
    rows = [(1, k, c) for k, c in enumerate(")(()((")] + [(2, 0, "x"), (3, 0, "(")]
    df = spark.createDataFrame(rows, "key int, at int, c string")
    got = {(r.key, r.at): (r.nest, r.partner, r.parent) for r in N.partners(df, ["key"], "at", F.when(F.col("c") == "(", 1).when(F.col("c") == ")", -1).otherwise(0)).collect()}
    assert got[2, 0] == (0, None, None) and got[3, 0] == (0, None, None) and got[1, 2] == (0, 3, 1) and got[1, 1][1] is None and got[1, 5][2] == 4
    assert N.innermost(df, df.where("false").select("key", F.col("at").alias("a"), F.col("at").alias("b")), ["key"], "at", "a", "b").where("a is null").count() == len(rows)


def test_spans_of_many_rows_take_more_tasks(spark):
    df = spark.createDataFrame([(k % 3, k, k + 2) for k in range(0, 60, 5)], "key int, at int, b int")
    spans, points = df.select("key", F.col("at").alias("a"), "b"), df.select("key", (F.col("at") + 1).alias("at"))
    few, many = (N.innermost(points, spans, ["key"], "at", "a", "b", rows) for rows in (0, 40_000_000))
    assert sorted(few.collect()) == sorted(many.collect()) and few.where("a = at - 1").count() == 12
    assert many.rdd.getNumPartitions() == 40


def test_links_of_chains_are_dealt_once(spark, monkeypatch):
    plans = []

    def cut(df, name, whole=G.cut):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return whole(df, name)

    monkeypatch.setattr(G, "cut", cut)
    known = spark.createDataFrame([(0, "A", None), (10, "B", None)], "node long, type string, argument string")
    links = spark.createDataFrame([(n + 1, n, "m" if n != 2 else None, 0) for n in range(5)] + [(11, 10, "no", 0)], "node long, receiver long, name string, size int")
    members = spark.createDataFrame([("A", "m", 0, "", "A", None, "A.m")], "type string, name string, size int, rank string, result string, argument string, member string")
    got = {(r.node, r.type, r.member) for r in G.typed_chains(known, links, members).collect()}
    assert got == {(0, "A", None), (10, "B", None), *((n, "A", None if n == 3 else "A.m") for n in range(1, 6))}
    rounds = [p for name, p in plans if name == "typed"][1:-1]
    assert len(rounds) == 6 and all("InMemoryTableScan" in p for p in rounds)
