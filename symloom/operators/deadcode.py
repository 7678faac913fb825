"""Code that nothing calls: candidates, false positives, category, confidence, evidence.

All repositories are judged at once; a caller filters by repository where one is
asked for. Every rule is a column expression on the symbol and the joins of a
few sets (overrides, exports, pairs of interface and implementation).

Defined cases: a null name or signature matches no pattern; symbols without a
file are no candidates; empty tables give no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that frameworks call, by language (fixed values).
ENTRY_NAMES = (
    r"^_Ready$", r"^_Process$", r"^_PhysicsProcess$", r"^_Input$", r"^_UnhandledInput$", r"^_ExitTree$", r"^_EnterTree$", r"^_Notification$", r"^_On[A-Z]", r"^On[A-Z]", r"^Handle[A-Z]",
    r"^Start$", r"^Update$", r"^FixedUpdate$", r"^Awake$", r"^OnEnable$", r"^OnDisable$", r"^OnDestroy$", r"^OnApplicationQuit$", r"^Main$", r"^Configure$", r"^ConfigureServices$",
    r"^componentDidMount$", r"^componentWillUnmount$", r"^componentDidUpdate$", r"^componentWillMount$", r"^shouldComponentUpdate$", r"^render$", r"^getInitialState$", r"^getDefaultProps$", r"^use[A-Z]",
    r"^mounted$", r"^created$", r"^beforeDestroy$", r"^destroyed$", r"^beforeMount$", r"^beforeUpdate$", r"^updated$", r"^activated$", r"^deactivated$", r"^setup$",
    r"^on[A-Z]", r"^handle[A-Z]", r"^onClick$", r"^onChange$", r"^onSubmit$", r"^onInput$", r"^main$", r"^default$",
    r"^handle$", r"^boot$", r"^booted$", r"^register$", r"^mount$", r"^schedule$", r"^commands$", r"^redirectTo$", r"^authenticate$",
    r"^prepareForValidation$", r"^withValidator$", r"^passedValidation$", r"^failedValidation$", r"^after$", r"^rules$", r"^messages$", r"^attributes$", r"^authorize$",
    r"^__construct$", r"^__destruct$", r"^__call$", r"^__get$", r"^__set$", r"^__isset$", r"^__unset$", r"^__toString$", r"^__invoke$",
)
#: Types and entities that are entered from outside (fixed values).
ENTRY_TYPES, ENTRY_ENTITIES = ("constructor", "destructor"), ("controller", "route", "middleware", "command", "listener")
#: Signatures that frameworks call (fixed values).
CALLBACK_SIGNATURES = (r"\boverride\b", r"\bvirtual\b", r"\boperator\b", r":\s*Attribute$", r"function\s+\w+\s*\([^)]*\)\s*:\s*Attribute", r"function\s+scope[A-Z]")
#: Tests by path, name and signature (fixed values).
TEST_PATHS = (r"\.test\.(ts|js|tsx|jsx|cs|php)$", r"\.spec\.(ts|js|tsx|jsx|cs|php)$", r"_test\.(ts|js|tsx|jsx|cs|php)$", r"Tests?\.(ts|js|tsx|jsx|cs|php)$", r"/[tT][eE][sS][tT][sS]?/", r"/__tests__/", r"/spec/")
TEST_NAMES = (r"^test[A-Z_]", r"^it_", r"^should_", r"^setUp$", r"^tearDown$", r"^beforeEach$", r"^afterEach$", r"^beforeAll$", r"^afterAll$")
TEST_SIGNATURES = (r"@Test", r"@Before", r"@After", r"\[Test\]", r"\[TestMethod\]")
#: Members that are read or written without a call (fixed values).
IMPLICIT_TYPES = ("property", "getter", "setter", "accessor", "field")
IMPLICIT_SIGNATURES = (r"\bget\s*\{", r"\bset\s*\{")
IMPLICIT_NAMES, IMPLICIT_BODY = (r"^get_", r"^set_", r"^Get[A-Z]", r"^Set[A-Z]"), r"\{\s*(get|set)\s*[;}]"
#: Signals and events (fixed values).
SIGNAL_NAMES, SIGNAL_SIGNATURES = (r"EventHandler$", r"Changed$", r"Completed$", r"Started$"), (r"\[Signal\]", r"\bevent\b", r"EventHandler<", r"delegate\s+void")
#: What is kept for old callers, and explicit members of interfaces (fixed values).
KEPT_NAMES, KEPT_SIGNATURES = (r"^(?i:deprecated)", r"^(?i:legacy)", r"^(?i:obsolete)"), (r"@deprecated", r"@obsolete", r"\[Obsolete\]", r"\[Deprecated\]")
EXPLICIT_SIGNATURES = (r"\bI[A-Z]\w+\.\w+\s*\(",)
#: Names that are often called by other means (fixed values).
GENERIC_NAMES = (r"^(?i:execute)$", r"^(?i:run)$", r"^(?i:invoke)$", r"^(?i:call)$", r"^(?i:apply)$", r"^(?i:process)$", r"^(?i:handle)$")
#: Paths of tests that are left out before anything else (LIKE patterns, fixed values).
TEST_LIKE = ("%.test.%", "%.spec.%", "%/tests/%", "%/__tests__/%", "%\\_test.%", "%Test.%", "%Tests.%")
CONFIDENCES = ("high", "medium", "low")
REASONS = {
    "interface_bloat": "Interface method implemented but never called anywhere", "dead_class": "Class with zero instantiations and no references",
    "dead_public_method": "Public method with zero callers, not exported, not an entry point", "dead_private_method": "Private method with zero callers, likely orphaned from refactoring",
    "dead_function": "Function with zero callers", "unused_export": "Exported symbol with zero imports - might be used externally or truly unused",
}


def _any(column: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a column matches one of some patterns; a null matches none."""
    return F.coalesce(column.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def candidates(symbols: DataFrame, dependencies: DataFrame, files: DataFrame, pattern: str | None = None, tests: bool = False) -> DataFrame:
    """Symbols with a file and no row of calls into them; pattern is a LIKE pattern of paths."""
    called = dependencies.where("dependency_type = 'calls' and to_symbol_id is not null").select("to_symbol_id")
    places = files.select(F.col("id").alias("f_id"), "path", "repo_id")
    if pattern:
        places = places.where(F.col("path").like(pattern))
    if not tests:
        for p in TEST_LIKE:
            places = places.where(~F.col("path").like(p))
    return symbols.join(called, F.col("id") == F.col("to_symbol_id"), "left_anti").join(places, F.col("file_id") == F.col("f_id")).drop("f_id")


def is_false_positive(include_exports: bool = False) -> Column:
    """Whether a candidate is called by other means, from its name, signature, types and path."""
    name, signature = F.col("name"), F.col("signature")
    implicit = F.col("symbol_type").isin(*IMPLICIT_TYPES) | _any(signature, IMPLICIT_SIGNATURES) | (_any(name, IMPLICIT_NAMES) & _any(signature, (IMPLICIT_BODY,)))
    rules = [
        F.col("symbol_type").isin(*ENTRY_TYPES), F.coalesce(F.col("entity_type").isin(*ENTRY_ENTITIES), F.lit(False)), _any(name, ENTRY_NAMES), _any(signature, CALLBACK_SIGNATURES),
        _any(F.col("path"), TEST_PATHS), _any(name, TEST_NAMES), _any(signature, TEST_SIGNATURES), F.coalesce(implicit, F.lit(False)), _any(name, SIGNAL_NAMES), _any(signature, SIGNAL_SIGNATURES),
        _any(name, KEPT_NAMES), _any(signature, KEPT_SIGNATURES), _any(signature, EXPLICIT_SIGNATURES),
    ]
    if not include_exports:
        rules.append(F.coalesce("is_exported", F.lit(False)))
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule, F.lit(False))
    return out


def interface_pairs(symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Methods in files of interfaces and those of the same name in files of classes that implement them: implementation_id, interface_name."""
    i = symbols.where("symbol_type = 'interface' or entity_type = 'interface'").select(F.col("id").alias("i_id"), F.col("file_id").alias("i_file"))
    c = symbols.select(F.col("id").alias("c_id"), F.col("file_id").alias("c_file"))
    d = dependencies.where("dependency_type = 'implements'").select("from_symbol_id", "to_symbol_id").distinct()
    pairs = d.join(i, F.col("to_symbol_id") == F.col("i_id")).join(c, F.col("from_symbol_id") == F.col("c_id")).select("i_file", "c_file").distinct()
    a = symbols.where("(symbol_type = 'method' or entity_type = 'interface_method') and name is not null").select(F.col("file_id").alias("a_file"), F.col("name").alias("interface_name")).distinct()
    b = symbols.where("symbol_type in ('method', 'class_method') and name is not null").select(F.col("file_id").alias("b_file"), F.col("name").alias("b_name"), F.col("id").alias("implementation_id"))
    named = pairs.join(a, F.col("i_file") == F.col("a_file")).select("c_file", "interface_name").distinct()
    return named.join(b, (F.col("c_file") == F.col("b_file")) & (F.col("interface_name") == F.col("b_name"))).select("implementation_id", "interface_name").distinct()


def is_private() -> Column:
    name = F.coalesce("name", F.lit(""))
    return _any(F.col("signature"), (r"\bprivate\b", r"\bprotected\b")) | name.startswith("#") | name.startswith("_")


def findings(
    symbols: DataFrame, dependencies: DataFrame, files: DataFrame, include_exports: bool = False, threshold: str = "low", pattern: str | None = None, tests: bool = False
) -> DataFrame:
    """Candidates that no rule explains, with category, confidence, reason and evidence.

    symbols: id, file_id, name, symbol_type, entity_type, signature, is_exported.
    threshold keeps findings that are at least that sure.
    """
    kept = candidates(symbols, dependencies, files, pattern, tests).where(~is_false_positive(include_exports))
    heirs = dependencies.where(F.col("dependency_type").isin("implements", "inherits", "extends")).select(F.col("from_symbol_id").alias("h_id")).distinct()
    bloat = interface_pairs(symbols, dependencies).groupBy(F.col("implementation_id").alias("b_id")).agg(F.min("interface_name").alias("interface_name"))
    joined = kept.join(heirs, F.col("id") == F.col("h_id"), "left").join(bloat, F.col("id") == F.col("b_id"), "left")
    exported, override = F.coalesce("is_exported", F.lit(False)), F.col("h_id").isNotNull()
    method = (F.col("symbol_type") == "method") | F.coalesce(F.col("entity_type").isin("method", "class_method"), F.lit(False))
    is_class = F.col("symbol_type").isin("class", "type_alias", "struct") | F.coalesce(F.col("entity_type") == "class", F.lit(False))
    category = (
        F.when(F.col("b_id").isNotNull(), "interface_bloat").when(exported, "unused_export").when(is_class, "dead_class").when(method & is_private(), "dead_private_method").when(method, "dead_public_method").otherwise("dead_function")
    )
    sure = category.isin("dead_private_method", "interface_bloat") | ((category == "dead_public_method") & ~exported & ~override) | ((category == "dead_class") & ~override)
    unsure = (category == "unused_export") | override | exported | _any(F.col("name"), GENERIC_NAMES)
    confidence = F.when(sure, "high").when(unsure, "low").otherwise("medium")
    evidence = F.struct(
        exported.alias("is_exported"), is_private().alias("is_private"), (F.col("signature").isNull() | _any(F.col("signature"), (r"\bpublic\b",))).alias("is_public"), override.alias("is_override"),
        F.col("b_id").isNotNull().alias("implements_interface"), "interface_name",
    )
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[category]
    allowed = CONFIDENCES[: CONFIDENCES.index(threshold) + 1]
    return joined.select("id", "name", "repo_id", "path", "symbol_type", category.alias("category"), confidence.alias("confidence"), reason.alias("reason"), evidence.alias("evidence")).where(F.col("confidence").isin(*allowed))


def limited(found: DataFrame, most: int) -> DataFrame:
    """At most so many findings, the surest first, ties by id."""
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence"))
    return found.orderBy(rank, "id").limit(most)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("category", "confidence").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("files"))
