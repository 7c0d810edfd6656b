"""Facts of a small service of our own."""

import pytest
from pyspark.sql import functions as F

from factloom.plans import enrichment as E
from factloom.plans.facts import Facts
from factloom.sources.java import read_sources, tokens
from factloom.sources.migrations import foreign_keys

SOURCES = {
    "app/src/main/java/shop/web/BookController.java": '''package shop.web;
import shop.core.*;
/** { not a brace } */
@RestController
@RequestMapping(path = "/books/")
class BookController {
    private final BookService books; // fields
    @Autowired
    private Clock clock;

    @GetMapping("/{id}")
    public Book find(@PathVariable("id") Long id) { return books.find(id); }

    @PostMapping
    public Book add(@Valid @RequestBody AddBook command) {
        return books.add(command.title());
    }

    @RequestMapping(value = "loan", method = RequestMethod.PUT)
    Book loan(@RequestBody Loan loan) {
        Book b = books.find(loan.id());
        b.lend();
        clock.now();
        return b;
    }
}
''',
    "app/src/main/java/shop/web/AddBook.java": '''package shop.web;
public record AddBook(@NotBlank String title, @Size(min = 1, max = 9) String code, int n) { }
''',
    "app/src/main/java/shop/web/Loan.java": '''package shop.web;
public class Loan { @NotNull private Long id; static int X = 1; public Long id() { return id; } }
''',
    "app/src/main/java/shop/core/BookService.java": '''package shop.core;
@Service
public class BookService {
    private static final String NAME = "a { b ; c";
    private final BookRepository repository;
    private final Bus bus;

    public Book find(Long id) {
        Objects.requireNonNull(id, "id is needed");
        Book book = repository.findOne(id);
        if (book == null) {
            throw new MissingBookException("no such book");
        }
        return check(book);
    }

    public Book add(String title) {
        Book book = new Book(title);
        bus.publishEvent(new BookAdded(book));
        return repository.save(book);
    }

    private Book check(Book book) { find(1L); return book; }
    private Book check(Book book, int n) { return book; }

    @EventListener
    void on(BookAdded event) { }

    @Scheduled(cron = "0 0 * * *")
    void sweep() { Runnable r = () -> { check(null); }; }
}
''',
    "app/src/main/java/shop/core/BookRepository.java": '''package shop.core;
interface BookRepository extends Repo<Book, Long> { Book findOne(Long id); }
''',
    "app/src/main/java/shop/core/Book.java": '''package shop.core;
@Entity @Table(name = "book")
public class Book {
    @Id private Long id;
    @Column(name = "book_title", nullable = false) private String title;
    @OneToMany(mappedBy = "book") private List<Copy> copies;
    private BookState state = BookState.FREE;
    Book(String title) { this.state = BookState.FREE; }
    void lend() { this.state = BookState.LENT; }
}
''',
    "app/src/main/java/shop/core/Jobs.java": '''package shop.core;
@Configuration
class Jobs implements CommandLineRunner {
    private Phase state;
    @Bean
    Consumer<BookAdded> stock() { return x -> { }; }
    public void run(String... args) { this.state = Phase.DONE; }
}
''',
    "app/src/main/java/shop/core/Phase.java": "package shop.core;\nenum Phase { OPEN, DONE; Phase next() { return DONE; } }\n",
    "app/src/main/java/shop/core/BookState.java": "package shop.core;\nenum BookState { FREE, LENT, GONE }\n",
    "app/src/main/java/shop/core/MissingBookException.java": "package shop.core;\n@ResponseStatus(HttpStatus.NOT_FOUND)\nclass MissingBookException extends RuntimeException { }\n",
    "app/src/test/java/shop/core/BookServiceTest.java": '''package shop.core;
class BookServiceTest {
    @Test @DisplayName("finds a book") void finds() { }
    @Test void addsA_newBook() { }
}
''',
    "app/build/src/main/java/shop/Old.java": "package shop; class Old { }",
    "app/src/main/java/shop/Broken.java": "package shop; class Broken { void f( { \" } ",
}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("service")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    with Facts(read_sources(spark, str(root))) as f:
        yield f


def test_tokens_and_files(spark, facts):
    assert facts.files.count() == len(SOURCES) - 1
    df = spark.createDataFrame([("f", "a /* x\n{ */ b\n\"}\" // {\nc")], "file string, text string")
    assert [(r.tok, r.line, r.depth) for r in tokens(df).orderBy("pos").collect()] == [("a", 1, 0), ("b", 2, 0), ('"}"', 3, 0), ("c", 4, 0)]


def test_declarations(facts):
    assert {(r.simple, r.kind) for r in facts.types.collect()} >= {("BookController", "class"), ("AddBook", "record"), ("BookState", "enum"), ("BookRepository", "interface")}
    assert {r.id for r in facts.methods.where("simple = 'BookService'").collect()} == {f"shop.core.BookService#{m}" for m in ("find", "add", "check", "check~24", "on", "sweep")}
    assert {(r.name, r.type) for r in facts.fields.where("type_id like '%Book' and not is_static").collect()} == {("id", "Long"), ("title", "String"), ("copies", "List<Copy>"), ("state", "BookState")}


def test_relations(facts):
    e = facts.entities().first()
    assert (e["name"], e["kind"], e["table"], e["line"]) == ("Book", "ENTITY", "book", 2)
    assert [(f["name"], f["column"], f["id"], f["nullable"]) for f in e["fields"]] == [("id", None, True, None), ("state", None, False, None), ("title", "book_title", False, False)]
    assert [tuple(r) for r in e["relations"]] == [("copies", "OneToMany", "Copy", "book", None, False)]
    assert {(r.id, r.line) for r in facts.entry_points().collect()} == {("http:GET /books/{id}", 11), ("http:POST /books", 14), ("http:PUT /books/loan", 19), ("event:shop.core.BookService#on(BookAdded)", 26), ("scheduled:BookService#sweep", 29), ("event:shop.core.Jobs#stock(BookAdded)", 5), ("cli:Jobs", 7)}
    assert {(r.enum_type, r.value, r.method) for r in facts.assignment_sites().collect()} == {("BookState", "FREE", None), ("BookState", "LENT", "lend"), ("Phase", "DONE", "run")}
    assert sorted((r.enum_type, r.states, len(r.sites)) for r in facts.state_machines().collect()) == [("BookState", ["FREE", "GONE", "LENT"], 2), ("Phase", ["DONE", "OPEN"], 1)]
    assert [(r.event, r.producers, r.consumers) for r in facts.event_flows().collect()] == [("BookAdded", ["BookService#add@19"], ["BookService#on@26", "Jobs#stock@5"])]
    assert {(r.test_class, r.target, r.certain, r.description) for r in facts.test_scenarios().collect()} == {("BookServiceTest", "BookService", True, "finds a book"), ("BookServiceTest", "BookService", True, "adds a new book")}
    assert {(r.entry_point, r.command_type, r.field, r.constraint, r.detail) for r in facts.input_constraints().collect()} == {("http:POST /books", "AddBook", "title", "NotBlank", None), ("http:POST /books", "AddBook", "code", "Size", "min=1, max=9"), ("http:PUT /books/loan", "Loan", "id", "NotNull", None)}


def test_graph_and_flows(facts):
    nodes, edges = facts.call_graph()
    s, c = "shop.core.BookService#", "shop.web.BookController#"
    assert {(r.a, r.b) for r in edges.collect()} == {(c + "find", s + "find"), (c + "add", s + "add"), (c + "loan", s + "find"), (c + "loan", "shop.core.Book#lend"), (c + "loan", "shop.web.Loan#id"), (c + "loan", "external:Clock#now"), (s + "find", "shop.core.BookRepository#findOne"), (s + "find", s + "check"), (s + "check", s + "find"), (s + "add", "external:Bus#publishEvent"), (s + "add", "external:BookRepository#save"), (s + "sweep", s + "check")}
    assert nodes.count() == 16
    assert {(r.class_name, r.role) for r in nodes.collect()} >= {("BookController", "controller"), ("BookService", "service"), ("BookRepository", "repository"), ("Book", "domain"), ("Clock", "external"), ("Loan", "other")}
    assert {(r.class_name, r.role, r.node) for r in facts.classes_by_role().where("class_name in ('Book', 'BookRepository')").collect()} == {("Book", "domain", "shop.core.Book#lend"), ("BookRepository", "external", "external:BookRepository#save")}
    alternatives, guards = facts.flows()
    assert {tuple(r) for r in alternatives.collect()} == {("http:GET /books/{id}", "MissingBookException", "404 NOT_FOUND", "no such book", "book == null"), ("http:PUT /books/loan", "MissingBookException", "404 NOT_FOUND", "no such book", "book == null")}
    assert {tuple(r) for r in guards.collect()} == {("http:GET /books/{id}", "id", "required"), ("http:PUT /books/loan", "id", "required")}


def test_migrations(spark):
    ddl = "create table if not exists a (b_id int not null references b(id), n int);\nCREATE TABLE c (x int, d_id int, constraint k foreign key (d_id) references d (key), e_id int REFERENCES e(id));\nalter table f add foreign key (g_id) references g(id);"
    got = {(r["table"], r["column"], r["ref_table"], r["ref_column"]) for r in foreign_keys(spark.createDataFrame([("V1", ddl)], "file string, text string")).collect()}
    assert got == {("a", "b_id", "b", "id"), ("c", "d_id", "d", "key"), ("c", "e_id", "e", "id"), ("f", "g_id", "g", "id")}


def test_gates_keep_only_what_joins_back(spark, facts):
    evidence = E.evidence_index(facts)
    site = facts.assignment_sites().where("value = 'LENT'").first()
    t = f'Here:\n```json\n[{{"from":"FREE","to":"LENT","trigger":"x","evidence":{{"file":"{site.file}","line":{site.line}}}}},{{"from":"FREE","to":"GONE","evidence":{{"file":"{site.file}","line":1}}}},{{"from":null,"to":"GONE","evidence":{{"file":"{site.file}","line":{site.line}}}}}]\n```'
    rows = E.parsed(spark.createDataFrame([("t", t), ("u", "no array"), ("v", "[broken")], "task string, answer string"), E.TRANSITION)
    assert [(r["from"], r["to"]) for r in E.gated_transitions(rows, evidence).collect()] == [("FREE", "LENT")]
    d = '[{"domain":"Lending","members":["Book","Nope","Book"]},{"domain":"Empty","members":["Nope"]},{"domain":" ","members":["Book"]}]'
    rows = E.parsed(spark.createDataFrame([("d", d)], "task string, answer string"), E.DOMAIN)
    assert [(r.domain, r.members) for r in E.gated_domains(rows, evidence).collect()] == [("Lending", ["Book", "Book"])]
    b = '[{"scenario":"s1","type":"odd","verifiedBy":["BookServiceTest#finds","X#y"],"coverage":{"level":"?"},"evidence":{"entryPoint":"http:POST /books","nodes":["shop.core.BookService#add","no#node"],"covers":["http:GET /none","http:PUT /books/loan"]}},{"scenario":"s2","evidence":{"entryPoint":"http:POST /books"}},{"scenario":"s3","priority":"low","type":"lifecycle","evidence":{"entryPoint":"http:GET /books/{id}"}},{"scenario":"s4","evidence":{"entryPoint":"http:GET /none"}}]'
    rows = E.parsed(spark.createDataFrame([("b", b)], "task string, answer string"), E.BEHAVIOUR)
    got = {(r.entry_point, r.scenario, r.type, r.priority, tuple(r.verified_by), tuple(r.nodes), tuple(r.covers), r.gap, r.coverage) for r in E.gated_behaviours(rows, evidence).collect()}
    assert got == {("http:POST /books", "s1", "happy-path", "medium", ("BookServiceTest#finds",), ("shop.core.BookService#add",), ("http:PUT /books/loan",), False, "partial"), ("http:GET /books/{id}", "s3", "lifecycle", "medium", (), (), (), True, None)}
    keys = {(r.kind, r.key) for r in evidence.collect()}
    assert keys >= {("entry_point", "cli:Jobs"), ("node", "external:Clock#now"), ("class", "Book"), ("scenario", "BookServiceTest#finds"), ("site", f"{site.file}:{site.line}")}


def test_hashes_and_cache(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3), (2, "y", 3)], "k int, s string, n int")
    assert E.artifact_hash(a).first() == E.artifact_hash(a.repartition(3).select("n", "s", "k")).first() != E.artifact_hash(a.distinct()).first()
    asked = E.prompts(spark.createDataFrame([("a", "m1"), ("b", "m2")], "task string, material string"), "Say what it does.")
    known = asked.where("task = 'a'").select("source_hash", "prompt_version", F.lit("[]").alias("answer"))
    hits, misses = E.split_by_cache(asked, known)
    assert [r.task for r in hits.collect()] == ["a"] and [r.task for r in misses.collect()] == ["b"]
    left = E.emit_requests(asked, known, str(tmp_path / "requests"))
    assert [r.task for r in left.collect()] == ["b"]
    E.remember(known, left.select("source_hash", "prompt_version", F.lit('x [{"domain":"D","members":["M"]}]').alias("answer")), str(tmp_path / "results"))
    rows = E.assemble(asked, spark.read.parquet(str(tmp_path / "results")), E.DOMAIN)
    assert [(r.task, r.domain) for r in rows.collect()] == [("b", "D")] and E.assemble(asked, known.where("false"), E.DOMAIN).count() == 0


def test_publishing_by_difference(spark, tmp_path):
    from factloom.plans import publish

    root, out = tmp_path / "service", str(tmp_path / "out")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "app/src/main/resources/db/migration").mkdir(parents=True)
    (root / "app/src/main/resources/db/migration/V1.sql").write_text("create table copy (book_id int references book(id));")
    first = publish.index(spark, str(root), out, mode="emit")
    assert first["artifacts"]["entry_points"]["rows"] == 7 and all(a["written"] for a in first["artifacts"].values())
    assert {r["model"] for rs in first["enrichment"].values() for r in rs} == {"pending"} and first["artifacts"]["enrichment_behaviours"]["rows"] == 0
    d = {r.entry_point: r.diagram for r in spark.read.parquet(f"{out}/sequence_diagrams").collect()}
    assert d["http:POST /books"].split("\n") == [
        "sequenceDiagram", "  actor Client", "  participant BookController", "  participant BookService", "  participant Bus", "  participant BookRepository", "  Client->>BookController: POST /books", "  BookController->>BookService: add", "  BookService->>Bus: publishEvent", "  BookService->>BookRepository: save", "  BookService-->>BookController: Book", "  BookController-->>Client: Book",
    ]
    assert d["http:GET /books/{id}"].split("\n")[-5:] == ["  alt book == null", "    BookController--xClient: 404 NOT_FOUND (MissingBookException)", "  else success", "    BookController-->>Client: Book", "  end"]
    assert d["event:shop.core.Jobs#stock(BookAdded)"].split("\n") == ["sequenceDiagram", "  participant BookAdded", "  participant Jobs", "  BookAdded-)Jobs: stock(BookAdded)", "  Note over Jobs: async, after commit"]
    made = lambda name: spark.read.parquet(f"{out}/{name}")
    assert made("er_diagrams").first().diagram.split("\n") == ["erDiagram", "  Book {", "    Long id PK", "    BookState state", "    String title", "  }"]
    assert made("event_flowchart").first().diagram.split("\n") == ["flowchart LR", '  E_BookAdded{{"BookAdded"}}', '  N_BookService["BookService"]', '  N_Jobs["Jobs"]', "  N_BookService -->|publishes| E_BookAdded", "  E_BookAdded --> N_BookService", "  E_BookAdded -.->|async| N_Jobs"]
    assert [(r["table"], r["column"], r["ref_table"]) for r in made("foreign_keys").collect()] == [("copy", "book_id", "book")]
    card = made("use_case_cards").where("entry_point = 'http:PUT /books/loan'").first()
    assert (card.category, card.class_name, [tuple(a) for a in card.alternatives], [tuple(c) for c in card.checks]) == ("REST", "BookController", [("MissingBookException", "404 NOT_FOUND", "when book == null")], [("id", "NotNull"), ("id", "required")])
    assert {r.domain: r.text for r in made("domain_map").collect()}["domain"] == "    domain\n      Book"
    assert made("state_diagrams").where("enum_type = 'BookState'").first().diagram.split("\n") == ["stateDiagram-v2", "  [*] --> FREE", "  FREE", "  GONE", "  LENT"]
    assert made("test_catalogue").first().text.split("\n") == ["BookServiceTest → BookService", "  finds a book", "  adds a new book"]
    assert publish.report(spark, out).where("html like '%<td>http:POST /books</td>%'").count() > 0 and made("unclassified").count() == 7

    asked = {name: spark.read.parquet(f"{out}/requests/{name}") for name in ("transitions", "domains", "behaviours")}
    assert all(q.count() == 1 for q in asked.values()) and '"throwSites":[{' in asked["behaviours"].first().material
    site = made("assignment_sites").where("value = 'LENT'").first()
    answers = {
        "transitions": f'[{{"from":"FREE","to":"LENT","trigger":"lend","evidence":{{"file":"{site.file}","line":{site.line}}}}}]', "domains": '[{"domain":"Lending","members":["Book"]}]',
        "behaviours": '[{"feature":"Books","scenario":"find","priority":"critical","coverage":{"level":"thin"},"evidence":{"entryPoint":"http:GET /books/{id}","covers":["http:PUT /books/loan"]}}]',
    }
    results = spark.createDataFrame([(q.first().source_hash, q.first().prompt_version, "someone", answers[name]) for name, q in asked.items()], "source_hash string, prompt_version string, model string, answer string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = publish.index(spark, str(root), out, mode="assemble", results=results)
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {name for name, a in again["artifacts"].items() if a["written"]} == {"state_diagrams", "domain_map", "use_case_rollup", "unclassified", "enrichment_transitions", "enrichment_domains", "enrichment_behaviours"}
    assert made("state_diagrams").where("enum_type = 'BookState'").first().diagram.split("\n") == ["stateDiagram-v2", "  [*] --> FREE", "  FREE --> LENT : lend"]
    assert made("domain_map").first().text == "    Lending\n      Book" and made("unclassified").count() == 5
    assert {(r.level, r.category, r.feature, r.total, r.gaps, r.critical_gaps, r.thin) for r in made("use_case_rollup").collect()} == {("all", None, None, 1, 1, 1, 1), ("category", "REST", None, 1, 1, 1, 1), ("feature", "REST", "Books", 1, 1, 1, 1)}
    assert spark.read.json(f"{out}/manifest").where("kind = 'enrichment' and model = 'someone'").count() == 3


def test_material_by_chunks(spark, facts):
    from factloom.plans.material import Material

    m = Material(facts)
    whole = m.behaviours().collect()
    assert [r.task for r in whole] == ["behaviours-0"] and '"stateMachines":[{' in whole[0].material and "BookServiceTest" in whole[0].material
    by_count = {r.class_name: r.chunk for r in m.chunks(size=4).collect()}
    assert by_count == {"BookController": 0, "BookService": 1, "Jobs": 1}
    by_size = {r.class_name: r.chunk for r in m.chunks(most=1).collect()}
    assert by_size == {"BookController": 0, "BookService": 1, "Jobs": 2}
    texts = {r.task: r.material for r in m.behaviours(size=3).collect()}
    assert "Clock" in texts["behaviours-0"] and "MissingBookException" in texts["behaviours-0"] and "Clock" not in texts["behaviours-1"] and "sweep" in texts["behaviours-1"] and '"stateMachines":[{' in texts["behaviours-1"]
    assert '"class":"Book"' in m.domains().first().material and '"enum_type":"BookState"' in m.transitions().first().material


def test_listing_prunes_and_keeps(spark, tmp_path):
    for at in ("app/src/main/java/a/_b/X.java", "app/src/main/java/a/build/No.java", "app/.git/src/main/java/No.java", "app/other/No.java", "lib/src/test/java/T.java", "skip/src/main/java/No.java"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("class X { }")
    (tmp_path / "lib/src/main/java").mkdir(parents=True)
    (tmp_path / "lib/src/main/java/Bad.java").write_bytes(b"\xff\xfe\xff")
    got = {r.file: (r.source_set, r.text is not None, r.error is not None) for r in read_sources(spark, str(tmp_path), exclude=("skip",)).collect()}
    assert got == {"app/src/main/java/a/_b/X.java": ("main", True, False), "lib/src/test/java/T.java": ("test", True, False), "lib/src/main/java/Bad.java": ("main", False, True)}
    assert {r.file for r in read_sources(spark, str(tmp_path / "app/other")).collect()} == {"No.java"}
    with Facts(read_sources(spark, str(tmp_path), exclude=("skip",))) as f:
        assert f.types.count() == 2


def test_publish_calls_and_guards_of_every_form(spark):
    body = """package a;
class Shop {
    void go(int n) {
        bus.send("topic", new Order(n, f(1, 2)));
        queue.convertAndSend("q", g(new Wrong()), new shop.ItemPaid(n));
        this.registerEvent(new ThingCreated());
        send(new Message());
        emit("a (, b", new PairEvent<A, B>(n));
        Guard.requireText(name, "no name");
        Guard.requireNonNegative(n);
    }
}
"""
    heard = "package a;\nclass Ear {\n    @EventListener\n    void on(Order o) { }\n}\n"
    files = spark.createDataFrame([("Shop.java", "main", body), ("Ear.java", "main", heard), ("ShopTest.java", "test", body.replace("Shop", "ShopTest"))], "file string, source_set string, text string")
    facts = Facts(files)
    flows = {r.event: len(r.producers or []) for r in facts.event_flows().collect()}
    assert flows == {"Order": 1, "ItemPaid": 1, "ThingCreated": 1, "PairEvent": 1}
    assert {(r.field, r.constraint) for r in facts.guard_checks().collect()} == {("name", "required text"), ("n", "must be ≥ 0")}


def test_entities_in_full(spark):
    body = """package a;
@Entity
class Order {
    @Id @GeneratedValue(strategy = GenerationType.IDENTITY) Long id;
    @Column(name = "code_", unique = true, length = 12, nullable = true) String code;
    @Convert(converter = MoneyConverter.class) Money total;
    @ManyToOne @JoinColumn(name = "buyer_id", nullable = false) Buyer buyer;
    @OneToMany(cascade = CascadeType.ALL, mappedBy = "order") Map<String, List<Line>> lines;
}
"""
    e = Facts(spark.createDataFrame([("Order.java", "main", body)], "file string, source_set string, text string")).entities().first()
    assert [tuple(f) for f in e.fields] == [("code", "String", "code_", False, False, True, True, 12, None), ("id", "Long", None, True, True, None, None, None, None), ("total", "Money", None, False, False, None, None, None, "MoneyConverter")]
    assert [tuple(r) for r in e.relations] == [("buyer", "ManyToOne", "Buyer", None, "buyer_id", True), ("lines", "OneToMany", "Line", "order", None, False)]


def test_triggers_of_every_form(spark):
    body = """package a;
@Component
class Ears {
    @KafkaListener(topics = "orders", groupId = "g") void one(Order o) { }
    @RabbitListener(queues = {"q1", "q2"}) void two(String s) { }
    @JmsListener(destination = Names.QUEUE) void three() { }
    @SqsListener("sq") void four() { }
    @ServiceActivator(inputChannel = "in") void five(Order o) { }
    @KafkaListener(groupId = "g") void six(Order o) { }
    @Async @EventListener(classes = Paid.class) void seven() { }
    @ApplicationModuleListener void eight(a.b.Paid p) { }
    @EventListener void nine() { }
    @Scheduled(fixedRate = 5000) void ten() { }
    @Scheduled(fixedDelay = 7) void eleven() { }
    @Scheduled(cron = "${a, b}") void twelve() { }
    @Bean Function<List<X>, Y> thirteen() { return null; }
}
@FeignClient
interface Remote { @GetMapping("/far") String far(); }
"""
    got = {r.method: (r.category, r.destination, r["async"], r.id.rpartition("#")[2]) for r in Facts(spark.createDataFrame([("Ears.java", "main", body)], "file string, source_set string, text string")).entry_points().collect()}
    assert got == {
        "one": ("event", "orders", True, "one(orders)"), "two": ("event", "q1", True, "two(q1)"), "three": ("event", "Names.QUEUE", True, "three(Names.QUEUE)"), "four": ("event", "sq", True, "four(sq)"), "five": ("event", "in", True, "five(in)"), "six": ("event", "Order", True, "six(Order)"),
        "seven": ("event", "Paid", True, "seven(Paid)"), "eight": ("event", "Paid", True, "eight(Paid)"), "nine": ("event", None, False, "nine@12"), "ten": ("scheduled", "fixedRate=5000", False, "ten"), "eleven": ("scheduled", "fixedDelay", False, "eleven"), "twelve": ("scheduled", "${a, b}", False, "twelve"), "thirteen": ("event", "List", True, "thirteen(List)"),
    }


def test_sources_in_a_folder_called_test(spark):
    body = "package a;\nclass Ear%d { @EventListener void hear(Paid p) { } }\n"
    files = spark.createDataFrame([(f, "other", body % k) for k, f in enumerate(("test/A.java", "x/test/B.java", "x/tests/C.java", "x/testing.java"))], "file string, source_set string, text string")
    for loose, want in ((False, {"test/A.java", "x/test/B.java", "x/tests/C.java", "x/testing.java"}), (True, {"x/tests/C.java", "x/testing.java"})):
        with Facts(files, loose_tests=loose) as f:
            assert {r.file for r in f.entry_points().collect()} == want


def test_exceptions_and_assignments_of_every_form(spark):
    body = """package a;
class Desk {
    private Phase phase;
    Loan find(Long id) {
        Loan loan = loans.byId(id).orElseThrow(() -> new MissingException("no loan, " + id));
        if (loan.isOver() && !(id >= 3)) throw new OverException(String.format("late %s", id), "x");
        if (id == null) {
            for (;;) { throw new NullException(); }
        } else if (id.equals(1L)) {
            loans.each(l -> { throw new EachException("a \\"b\\" (c"); });
        } else {
            fail(new FirstException(id, "not me"), new SecondException(
                "me"));
        }
        return loan;
    }
    void move(Loan loan, Phase next) {
        phase = OPEN;
        this.phase = (Phase.DONE);
        if (next == null) phase = Phase.OPEN;
        loan.phase = next;
        next = pick(1, 2);
        int n = 1;
        n = 2;
    }
}
class Loan { Phase phase; }
enum Phase { OPEN, DONE }
"""
    facts = Facts(spark.createDataFrame([("Desk.java", "main", body), ("DeskTest.java", "test", body)], "file string, source_set string, text string"))
    got = {r.exception_type: (r.message, r.condition, r.line) for r in facts.throw_sites().collect()}
    assert got == {
        "MissingException": ("no loan, ", None, 5), "OverException": (None, "loan.isOver() && !(id >= 3)", 6), "NullException": (None, "id == null", 8),
        "EachException": ('a \\"b\\" (c', "id.equals(1L)", 10), "FirstException": (None, "id.equals(1L)", 12), "SecondException": ("me", "id.equals(1L)", 12),
    }
    sites = {(r.line, r.enum_type, r.field, r.value, r.class_name, r.method) for r in facts.assignment_sites().where("file = 'Desk.java'").collect()}
    assert sites == {(18, "Phase", "phase", "OPEN", "Desk", "move"), (19, "Phase", "phase", "(Phase.DONE)", "Desk", "move"), (20, "Phase", "phase", "OPEN", "Desk", "move"), (21, "Phase", "phase", "next", "Desk", "move"), (22, "Phase", "next", "pick(1, 2)", "Desk", "move")}


def test_diagrams_by_module(spark):
    from factloom.plans import publish

    kind = "name string, file string, fields array<struct<name:string,type:string,id:boolean>>, relations array<struct<field:string,kind:string,target:string>>"
    e = spark.createDataFrame([("A", "x/y/one/A.java", [("id", "Long", True)], [("b", "OneToMany", "B"), ("c", "ManyToOne", "C")]), ("B", "x/y/one/deep/B.java", [], []), ("C", "x/y/two/C.java", [("n", "List<X>", False)], [])], kind)
    got = {r.module: r.diagram.split("\n") for r in publish.er_diagrams(e).collect()}
    assert got == {"one": ["erDiagram", "  A {", "    Long id PK", "  }", "  B {", "  }", '  A ||--o{ B : "b"'], "two": ["erDiagram", "  C {", "    List_X_ n", "  }"]}
    assert publish.er_diagrams(e.where("false")).count() == 0
