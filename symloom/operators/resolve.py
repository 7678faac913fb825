"""Names to symbols: candidate joins with a priority, ambiguity kept or dropped by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.session import WAVES, cores, cut


def resolve_by_cascade(dependencies: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of unresolved dependencies: qualified name first, then name in the same file, then a name that is unique in the repository.

    Each rule is an equality join; a dependency takes the first rule that gives
    it a target, and of several targets the smallest id, with their number.
    """
    open_ = dependencies.where("to_symbol_id is null").select("id", "from_symbol_id", "to_symbol", "to_qualified_name")
    places = symbols.select("id", "name", "qualified_name", "file_id").join(
        files.select(F.col("id").alias("f_id"), "repo_id"), F.col("file_id") == F.col("f_id"), "left"
    )
    origin = places.select(F.col("id").alias("o_id"), F.col("file_id").alias("o_file"), F.col("repo_id").alias("o_repo"))
    asked = open_.join(origin, F.col("from_symbol_id") == F.col("o_id"), "left")

    by_qualified = (
        symbols.where("qualified_name is not null").groupBy(F.col("qualified_name").alias("k")).agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n"))
    )
    by_file = (
        symbols.where("name is not null").groupBy(F.col("file_id").alias("kf"), F.col("name").alias("kn")).agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n"))
    )
    by_repo = (
        places.where("name is not null").groupBy(F.col("repo_id").alias("kr"), F.col("name").alias("kn")).agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1")
    )
    hits = (
        asked.join(by_qualified, F.col("to_qualified_name") == F.col("k")).select("id", "target", "n", F.lit(1).alias("rule"))
        .unionByName(asked.join(by_file, (F.col("o_file") == F.col("kf")) & (F.col("to_symbol") == F.col("kn"))).select("id", "target", "n", F.lit(2).alias("rule")))
        .unionByName(asked.join(by_repo, (F.col("o_repo") == F.col("kr")) & (F.col("to_symbol") == F.col("kn"))).select("id", "target", "n", F.lit(3).alias("rule")))
    )
    best = hits.groupBy("id").agg(F.min(F.struct("rule", "target", "n")).alias("best"))
    return best.select("id", F.col("best.target").alias("to_symbol_id"), F.col("best.rule").alias("rule"), F.col("best.n").alias("candidates"))


def link_parents(symbols: DataFrame) -> DataFrame:
    """Innermost class, interface or trait around each method and property of a file, by lines.

    A join on the file with a range condition; a file's symbols are few.
    """
    inner = symbols.where(F.col("symbol_type").isin("method", "property")).select("id", "file_id", "start_line", "end_line")
    outer = symbols.where(F.col("symbol_type").isin("class", "interface", "trait")).select(
        F.col("id").alias("parent_id"), F.col("file_id").alias("p_file"), F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end")
    )
    hit = inner.join(
        outer, (F.col("file_id") == F.col("p_file")) & (F.col("start_line") >= F.col("p_start")) & (F.col("end_line") <= F.col("p_end")) & (F.col("id") != F.col("parent_id"))
    )
    best = hit.groupBy("id").agg(F.min(F.struct((F.col("p_end") - F.col("p_start")).alias("span"), "parent_id")).alias("best"))
    return best.select("id", F.col("best.parent_id").alias("parent_id"))


#: Entity rules (fixed values): framework, symbol type (* for all without rules of their own), what is looked at, pattern, entity type, priority, endings of files it holds for.
RULES: tuple[tuple[str, str, str, str, str, int, str], ...] = (
    ("laravel", "class", "suffix", "Controller", "controller", 10, ""), ("laravel", "class", "suffix", "Job", "job", 10, ""), ("laravel", "class", "suffix", "Service", "service", 10, ""), ("laravel", "class", "suffix", "Repository", "repository", 10, ""),
    ("laravel", "class", "folder", "/Models/", "model", 5, ""), ("laravel", "class", "folder", "/Controllers/", "controller", 5, ""), ("laravel", "class", "folder", "/Jobs/", "job", 5, ""), ("laravel", "class", "folder", "/Middleware/", "middleware", 5, ""),
    ("laravel", "class", "base", "Model", "model", 1, ""), ("laravel", "class", "base", "Controller", "controller", 1, ""), ("laravel", "class", "base", "Job", "job", 1, ""), ("laravel", "class", "base", "Middleware", "middleware", 1, ""),
    ("laravel", "class", "base", "Request", "request", 1, ""), ("laravel", "class", "base", "FormRequest", "request", 1, ""), ("laravel", "class", "base", "Resource", "api_resource", 1, ""), ("laravel", "class", "base", "Notification", "notification", 1, ""),
    ("laravel", "class", "base", "Command", "command", 1, ""), ("laravel", "class", "base", "Seeder", "seeder", 1, ""), ("laravel", "class", "base", "Migration", "migration", 1, ""), ("laravel", "class", "base", "ServiceProvider", "provider", 1, ""),
    ("vue", "component", "ending", ".vue", "component", 20, ""), ("vue", "*", "folder", "/components/", "component", 5, ""), ("vue", "function", "prefix", "^use[A-Z]", "composable", 10, ".ts .js .vue"), ("vue", "function", "prefix", "^create[A-Z]", "composable", 10, ".ts .js"), ("vue", "class", "suffix", "Service", "service", 10, ""),
    ("react", "function", "suffix", "Provider", "provider", 10, ""), ("react", "function", "prefix", "^[A-Z]", "component", 10, ".jsx .tsx"), ("react", "function", "prefix", "^use[A-Z]", "hook", 15, ""), ("react", "function", "folder", "/components/", "component", 5, ""), ("react", "function", "folder", "/hooks/", "hook", 5, ""),
    ("react", "class", "base", "Component", "component", 1, ""), ("react", "class", "base", "PureComponent", "component", 1, ""),
    ("typescript", "interface", "suffix", "Props", "props_interface", 10, ""), ("typescript", "interface", "suffix", "State", "state_interface", 10, ""), ("typescript", "interface", "suffix", "Config", "config", 10, ""), ("typescript", "interface", "prefix", "^I[A-Z]", "interface", 5, ""),
    ("godot", "class", "suffix", "Manager", "manager", 10, ""), ("godot", "class", "suffix", "Service", "service", 10, ""), ("godot", "class", "suffix", "Handler", "handler", 10, ""), ("godot", "class", "suffix", "Controller", "controller", 10, ""), ("godot", "class", "suffix", "Component", "component", 10, ""),
    ("godot", "class", "suffix", "Factory", "factory", 10, ""), ("godot", "class", "suffix", "Builder", "builder", 10, ""), ("godot", "class", "suffix", "Provider", "provider", 10, ""), ("godot", "class", "suffix", "Repository", "repository", 10, ""), ("godot", "class", "suffix", "Coordinator", "coordinator", 10, ""),
    ("godot", "class", "suffix", "Engine", "engine", 10, ""), ("godot", "class", "suffix", "Exception", "exception", 10, ""), ("godot", "class", "suffix", "Strategy", "strategy", 10, ""), ("godot", "class", "suffix", "State", "state", 10, ""), ("godot", "class", "suffix", "StateMachine", "state_machine", 11, ""),
    ("godot", "class", "suffix", "Policy", "policy", 10, ""), ("godot", "class", "suffix", "Configuration", "configuration", 10, ""), ("godot", "class", "suffix", "Config", "configuration", 10, ""), ("godot", "class", "suffix", "Constants", "constants", 10, ""), ("godot", "class", "suffix", "Const", "constants", 10, ""),
    ("godot", "class", "suffix", "Paths", "constants", 10, ""), ("godot", "class", "suffix", "Events", "event_bus", 10, ""), ("godot", "class", "suffix", "EventArgs", "event", 10, ""), ("godot", "class", "suffix", "Attribute", "attribute", 10, ""), ("godot", "class", "suffix", "Pool", "pool", 10, ""),
    ("godot", "class", "suffix", "Statistics", "metrics", 10, ""), ("godot", "class", "suffix", "Metrics", "metrics", 10, ""), ("godot", "class", "suffix", "Info", "data_model", 8, ""), ("godot", "class", "suffix", "Result", "data_model", 10, ""), ("godot", "class", "suffix", "Report", "data_model", 10, ""),
    ("godot", "class", "suffix", "Summary", "data_model", 10, ""), ("godot", "class", "suffix", "Data", "data_model", 7, ""), ("godot", "class", "suffix", "DTO", "data_model", 10, ""), ("godot", "class", "suffix", "Rules", "rules", 10, ""), ("godot", "class", "suffix", "Validator", "validator", 10, ""),
    ("godot", "class", "suffix", "Subscription", "subscription", 10, ""), ("godot", "class", "suffix", "Effect", "effect", 9, ""), ("godot", "class", "suffix", "Adapter", "adapter", 10, ""), ("godot", "class", "suffix", "Wrapper", "wrapper", 10, ""), ("godot", "class", "suffix", "Helper", "helper", 10, ""),
    ("godot", "class", "suffix", "Util", "utility", 10, ""), ("godot", "class", "suffix", "Utility", "utility", 10, ""),
    ("godot", "class", "base", "Node", "node", 1, ""), ("godot", "class", "base", "Node2D", "node", 1, ""), ("godot", "class", "base", "Node3D", "node", 1, ""), ("godot", "class", "base", "Control", "ui_component", 1, ""), ("godot", "class", "base", "Resource", "resource", 1, ""),
    ("godot", "class", "base", "RefCounted", "resource", 1, ""), ("godot", "class", "base", "EventArgs", "event", 2, ""), ("godot", "class", "base", "Exception", "exception", 2, ""), ("godot", "class", "base", "Attribute", "attribute", 2, ""),
)
#: Rules that do not hold for classes of a base: (framework, suffix, base) (fixed values).
EXCEPTIONS = (("godot", "Controller", "Controller"),)
#: Base classes that tell the engine of a C# file (fixed values).
ENGINE_BASES = (
    "Node", "Node2D", "Node3D", "Control", "Resource", "RefCounted", "Object", "PackedScene", "GodotObject", "Area2D", "Area3D", "RigidBody2D", "RigidBody3D", "CharacterBody2D", "CharacterBody3D", "StaticBody2D", "StaticBody3D",
)


def framework_of(path: Column, base: Column, namespace: Column) -> Column:
    """Framework of a file without one: by its ending, and by base class and namespace where these decide; else null."""
    b, n = F.coalesce(base, F.lit("")), F.coalesce(namespace, F.lit(""))
    return (
        F.when(path.endswith(".php"), F.when(n.startswith("Illuminate\\") | b.startswith("Illuminate\\"), "laravel"))
        .when(path.endswith(".cs"), F.when(n.startswith("Godot.") | b.isin(*ENGINE_BASES), "godot").otherwise("csharp"))
        .when(path.endswith(".vue"), "vue")
        .when(path.rlike(r"\.(tscn|godot)$"), "godot")
    )


def classify(symbols: DataFrame, files: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Entity type of each symbol by the rule of the highest priority that holds, the first of equals, else its symbol type.

    symbols: id, name, symbol_type, file_id, framework, base_class, namespace;
    a symbol without a framework gets that of its file. Returns id, framework,
    entity and the rule.
    """
    joined = symbols.join(files.select(F.col("id").alias("f_id"), "path"), F.col("file_id") == F.col("f_id"), "left")
    name, path, base = F.coalesce("name", F.lit("")), F.coalesce("path", F.lit("")), F.trim(F.split(F.coalesce("base_class", F.lit("")), ",")[0])
    framework = F.coalesce("framework", framework_of(path, base, F.col("namespace")))
    own = {(f, t) for f, t, *_ in rules}
    chosen = F.lit(None).cast("string")
    for fw, kind, how, pattern, entity, _, endings in sorted(rules, key=lambda r: -r[5])[::-1]:
        held = {"suffix": lambda p: name.endswith(p), "prefix": lambda p: name.rlike(p), "folder": lambda p: F.contains(path, F.lit(p)), "ending": lambda p: path.endswith(p), "base": lambda p: base == p}[how](pattern)
        others = [t for f, t in own if f == fw and t != "*"]
        types = F.col("symbol_type") == kind if kind != "*" else ~F.col("symbol_type").isin(*others)
        ok = (F.col("fw") == fw) & types & held
        if endings:
            fits = F.lit(False)
            for e in endings.split():
                fits = fits | path.endswith(e)
            ok = ok & fits
        for f, suffix, not_base in EXCEPTIONS:
            if how == "suffix" and (f, suffix) == (fw, pattern):
                ok = ok & (base != not_base)
        chosen = F.when(ok, F.lit(f"{entity}|{how}: {pattern}")).otherwise(chosen)
    out = joined.withColumn("fw", framework).select("id", "symbol_type", F.col("fw").alias("framework"), chosen.alias("chosen"))
    return out.select("id", "framework", F.coalesce(F.substring_index("chosen", "|", 1), "symbol_type").alias("entity"), F.regexp_extract("chosen", r"^[^|]*\|(.*)$", 1).alias("rule"))


def sample_parents(symbols: DataFrame, most: int) -> DataFrame:
    """Symbols with at most so many rows per parent, the smallest ids."""
    order = Window.partitionBy("parent_symbol_id").orderBy("id")
    return symbols.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


#: First parts of names that belong to a framework or the standard library (fixed values).
EXTERNAL = (
    "Godot", "System", "Variant", "FileAccess", "Json", "Error", "SceneTree", "List", "Dictionary", "HashSet", "Queue", "Stack", "Exception", "ArgumentException", "InvalidOperationException",
    "DateTime", "TimeSpan", "Guid", "Uri", "Task", "Thread", "Node", "Node2D", "Node3D", "Control", "Resource", "Object", "Vector2", "Vector3", "Color", "Transform2D", "Transform3D",
    "AnimationPlayer", "AnimationTree", "AudioStreamPlayer", "AudioStreamPlayer2D", "AudioStreamPlayer3D", "Camera2D", "Camera3D", "CollisionShape2D", "CollisionShape3D",
    "Label", "Button", "TextureRect", "Sprite2D", "Sprite3D", "Timer", "Area2D", "Area3D", "CharacterBody2D", "CharacterBody3D", "RigidBody2D", "RigidBody3D", "StaticBody2D", "StaticBody3D",
    "TileMap", "NavigationAgent2D", "NavigationAgent3D",
)
#: Parts of a name that make it external wherever they stand (fixed values).
EXTERNAL_PARTS = ("Type", "ModeFlags", "SignalName")


def language_group(path: Column) -> Column:
    """Group of languages whose symbols may refer to each other, by the ending of a path."""
    return (
        F.when(path.endswith(".php"), "php").when(path.rlike(r"\.(tsx?|jsx?|vue)$"), "script").when(path.endswith(".cs"), "csharp").when(path.endswith(".py"), "python").otherwise("unknown")
    )


def plain_name(name: Column) -> Column:
    """A name without type arguments."""
    return F.regexp_replace(name, r"<.*$", "")


def is_external(name: Column) -> Column:
    parts = F.split(plain_name(name), r"\.")
    return F.element_at(parts, 1).isin(*EXTERNAL) | ((F.size(parts) > 1) & F.arrays_overlap(parts, F.array(*map(F.lit, EXTERNAL_PARTS))))


def is_instance_access(name: Column) -> Column:
    """Whether a dotted name starts in small letters or with an underscore."""
    first = F.substring(F.substring_index(name, ".", 1), 1, 1)
    return F.contains(name, F.lit(".")) & (first != "") & ((first == F.lower(first)) | (first == "_"))


def context_class(context: Column) -> Column:
    """Class that a call's context names, in small letters."""
    field = F.regexp_replace(F.regexp_replace(context, "^field_call_", ""), "^_", "")
    return F.lower(F.when(context.startswith("field_call_"), field).otherwise(F.substring_index(context, ".", 1)))


#: Symbols of one name and language that a row meets at once; names of more are cut into slices (fixed value).
SLICE = 1024
#: What makes two rows the same edge, before their target is known.
_EDGE = ("from_symbol_id", "dependency_type", "line_number", "member")
#: Whether a symbol of a plain name makes an edge of its own.
_NEW = "from_symbol_id <> m_id and not coalesce(array_contains(taken, m_id), false)"


def _meant(dependencies: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Resolved calls; qualified edges of other kinds; what of other kinds means all symbols of a name; these symbols.

    Edges of other kinds that mean a plain name are not written out: a name has
    as many as its references times its symbols. One row stands for all edges
    of (from_symbol_id, dependency_type, line_number, member) but those to
    taken, which qualified names of the same line gave before.
    """
    place = files.select(F.col("id").alias("f_id"), language_group(F.col("path")).alias("group"))
    s = symbols.join(place, F.col("file_id") == F.col("f_id"), "left").withColumn("group", F.coalesce("group", F.lit("unknown")))
    s = cut(s.select("id", "name", "symbol_type", "file_id", "start_line", "parent_symbol_id", "group"))
    named = s.where("name is not null")
    # what is asked and who inherits, as one table, so that dependencies are read once
    is_asked = F.expr("from_symbol_id is not null and to_symbol is not null and (calling_object is null or resolved_class is not null)")
    inherits = F.lit(False)
    if "to_symbol_id" in dependencies.columns:
        inherits = F.col("dependency_type").isin("implements", "inherits") & F.col("to_symbol_id").isNotNull()
    asked, context = plain_name(F.col("to_symbol")), F.coalesce("resolved_class", "qualified_context")
    dotted = F.contains(asked, F.lit("."))
    known = cut(
        dependencies.where(is_asked | inherits).select(
            "id", "from_symbol_id", "dependency_type", "line_number", is_asked.alias("is_asked"),
            (F.when(inherits, F.col("to_symbol_id")) if "to_symbol_id" in dependencies.columns else F.lit(None).cast("long")).alias("heir_of"),
            F.when(dotted, F.regexp_extract(asked, r"^(.*)\.[^.]*$", 1)).alias("qualifier"),
            F.substring_index(asked, ".", -1).alias("member"),
            (~(dotted & (is_external(asked) | is_instance_access(asked)))).alias("open"),
            context.isNotNull().alias("has_context"),
            context_class(context).alias("wanted"),
        )
    )
    origin = s.select(F.col("id").alias("o_id"), F.col("name").alias("o_name"), F.col("group").alias("o_group"), F.col("file_id").alias("o_file"))
    rows = known.where("is_asked").join(origin, F.col("from_symbol_id") == F.col("o_id")).drop("o_id", "is_asked", "heir_of")

    # members by the qualifiers that are asked for: of classes, of classes below interfaces, constants of enums
    sought = known.where("is_asked and qualifier is not null").select(F.col("qualifier").alias("q")).distinct()
    classes = named.where(F.col("symbol_type").isin("class", "interface")).select(F.col("id").alias("c_id"), F.col("name").alias("q"), F.col("file_id").alias("c_file"), F.col("start_line").alias("c_start"))
    heirs = known.where("heir_of is not null").select(F.col("from_symbol_id").alias("h_id"), "heir_of").distinct()
    above = named.select(F.col("id").alias("n_id"), F.col("name").alias("q")).join(sought, "q", "left_semi")
    below = above.join(heirs, F.col("n_id") == F.col("heir_of")).join(classes.drop("q"), F.col("h_id") == F.col("c_id"))
    owners = classes.join(sought, "q", "left_semi").withColumn("tier", F.lit(1)).unionByName(below.select("c_id", "q", "c_file", "c_start").withColumn("tier", F.lit(2)))
    m = named.select(F.col("id").alias("m_id"), F.col("name").alias("n"), F.col("group").alias("g"), F.col("file_id").alias("m_file"), F.col("start_line").alias("m_start"))
    members = owners.join(m, (F.col("c_file") == F.col("m_file")) & (F.col("m_start") >= F.col("c_start")) & (F.col("c_id") != F.col("m_id")))
    e = named.where("symbol_type = 'enum'").select(F.col("id").alias("e_id"), F.col("name").alias("q")).join(sought, "q", "left_semi")
    constants = named.where("symbol_type in ('constant', 'property')").select("parent_symbol_id", F.col("id").alias("m_id"), F.col("name").alias("n"), F.col("group").alias("g"), F.col("file_id").alias("m_file"))
    shape = ("q", "tier", "n", "g", "m_id", "m_file")
    by_qualifier = members.select(*shape).unionByName(e.join(constants, F.col("e_id") == F.col("parent_symbol_id")).withColumn("tier", F.lit(1)).select(*shape)).distinct()

    # one row per qualifier, name and language, and per name and language: how many symbols and the first of them
    count, first = F.count(F.lit(1)).alias("count"), F.min("m_id").alias("first")
    summed = by_qualifier.groupBy("q", "n", "g", "tier").agg(count, first).groupBy("q", F.col("n").alias("q_n"), F.col("g").alias("q_g")).agg(F.min(F.struct("tier", "count", "first")).alias("k"))
    names = m.groupBy("n", "g").agg(count, first)
    owner = named.select(F.col("id").alias("p_id"), F.lower("name").alias("p_name"))
    in_class = named.join(owner, F.col("parent_symbol_id") == F.col("p_id")).groupBy(F.col("name").alias("x_n"), F.col("group").alias("x_g"), "p_name").agg(F.min("id").alias("in_class"))
    fits = (F.col("member") == F.col("n")) & (F.col("o_group") == F.col("g"))

    def chosen(part: DataFrame) -> DataFrame:
        """The best tier of each row that has one, with the number of its symbols and the first."""
        plain = part.where("qualifier is null").join(names, fits).select(*part.columns, F.lit(3).alias("tier"), "count", "first")
        by_q = (F.col("qualifier") == F.col("q")) & (F.col("member") == F.col("q_n")) & (F.col("o_group") == F.col("q_g"))
        both = part.where("qualifier is not null").join(summed, by_q, "left").join(names, fits & F.col("open") & F.col("k").isNull(), "left").where("k is not null or count is not null")
        best = [F.coalesce("k.tier", F.lit(3)).alias("tier"), F.coalesce("k.count", "count").alias("count"), F.coalesce("k.first", "first").alias("first")]
        return plain.unionByName(both.select(*part.columns, *best))

    # calls: one target each
    calls = chosen(rows.where("dependency_type = 'calls'").drop("o_name", "o_file"))
    calls = calls.join(in_class, (F.col("member") == F.col("x_n")) & (F.col("o_group") == F.col("x_g")) & (F.col("wanted") == F.col("p_name")), "left")
    one = F.col("count") == 1
    target = F.when(one, F.col("first")).when(F.col("in_class").isNotNull(), F.col("in_class")).when(F.col("has_context"), F.col("first"))
    how = F.when(F.col("tier") == 1, "qualified").when(F.col("tier") == 2, "interface").otherwise("name")
    strategy = F.when(one, how).when(F.col("in_class").isNotNull(), "context").otherwise("first")
    resolved = calls.select("id", "from_symbol_id", "dependency_type", "line_number", target.alias("to_id"), strategy.alias("strategy")).where("to_id is not null")
    resolved = _once(resolved)

    # other kinds: every target of the best tier. Targets of two members differ, so rows of the same edge on one line are among those of one member
    rest = chosen(rows.where("dependency_type <> 'calls'").drop("has_context", "wanted"))
    edge = [*_EDGE, "o_name", "o_group", "o_file"]
    each = rest.groupBy(*edge, "tier", F.when(F.col("tier") < 3, F.col("qualifier")).alias("q")).agg(F.min("id").alias("id"), F.max("count").alias("count"))
    wide, ways = F.col("tier") == 3, F.collect_list(F.when(F.col("tier") < 3, F.struct("id", "tier", "q")))
    # the plain name means all that a qualified one does, so of qualified ones only those before it count
    per = each.groupBy(*edge).agg(F.min(F.when(wide, F.col("id"))).alias("id"), F.max(F.when(wide, F.col("count"))).alias("count"), ways.alias("ways"))
    per = cut(per.withColumn("ways", F.filter("ways", lambda w: F.col("id").isNull() | (w["id"] < F.col("id")))))
    narrow = per.select(*edge, (F.col("id").isNull() & (F.size("ways") == 1)).alias("alone"), F.col("id").isNotNull().alias("has_plain"), F.inline("ways"))
    hit = narrow.join(by_qualifier.withColumnsRenamed({"q": "r_q", "tier": "r_tier"}), fits & (F.col("q") == F.col("r_q")) & (F.col("tier") == F.col("r_tier")))
    hit = hit.where("from_symbol_id <> m_id and (dependency_type <> 'contains' or o_file = m_file)").select("id", *_EDGE, F.col("m_id").alias("to_id"), how.alias("strategy"), "alone", "has_plain")
    alone = hit.where("alone").select("id", "from_symbol_id", "to_id", "dependency_type", "line_number", "strategy")
    qualified = alone.unionByName(_once(hit.where("not alone")))
    taken = hit.where("has_plain").groupBy(*[F.col(c).alias(f"t_{c}") for c in _EDGE]).agg(F.collect_set("to_id").alias("taken"))
    same = F.lit(True)
    for c in _EDGE:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    after = per.where("id is not null and size(ways) > 0").drop("ways").join(taken, same, "left").drop(*[f"t_{c}" for c in _EDGE])
    plain = per.where("id is not null and size(ways) = 0").drop("ways").withColumn("taken", F.lit(None).cast("array<bigint>")).unionByName(after)
    sizes = names.select(F.col("n").alias("k_n"), F.col("g").alias("k_g"), F.col("count").alias("of_name"))
    targets = m.join(sizes, (F.col("n") == F.col("k_n")) & (F.col("g") == F.col("k_g"))).select("n", "g", "m_id", "m_file", "of_name")
    return resolved, qualified, plain, targets


def _once(edges: DataFrame) -> DataFrame:
    """Rows of the same edge on one line as one, that of the smallest id."""
    one = edges.groupBy("from_symbol_id", "to_id", "dependency_type", "line_number").agg(F.min(F.struct("id", "strategy")).alias("k"))
    return one.select("k.id", "from_symbol_id", "to_id", "dependency_type", "line_number", "k.strategy")


def _contained(plain: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges to contained symbols of a plain name; they meet by file, so a name costs no product."""
    held = plain.where("dependency_type = 'contains'").join(targets, (F.col("member") == F.col("n")) & (F.col("o_group") == F.col("g")) & (F.col("o_file") == F.col("m_file")))
    return held.where(_NEW).select("id", "from_symbol_id", F.col("m_id").alias("to_id"), "dependency_type", "line_number", F.lit("name").alias("strategy"))


def build_edges(dependencies: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from parsed dependencies to the symbols they mean: id, from_id, to_id, kind, line_number, strategy.

    dependencies: id, from_symbol_id, to_symbol, dependency_type, line_number,
    calling_object, resolved_class, qualified_context. symbols: id, name,
    symbol_type, file_id, start_line, parent_symbol_id.

    A name with a qualifier means a member of a class, interface or enum of that
    name, else of a class that implements an interface of that name, else, unless
    the qualifier is external or an object, any symbol of the last part's name;
    languages must fit. A call to one of several symbols takes the one whose
    class its context names, else the first of that context's implementations,
    else the first of all; without a context it is dropped as ambiguous, and so
    is a call on an object of unknown class. Self-edges are calls only, and
    contained symbols lie in the same file.

    Calls meet names as one row per name, class and language, so a name that a
    third of all symbols bear costs no product. Other kinds mean every symbol of
    a name; rows of the same edge become one before they meet the symbols, and
    what comes out of that is neither sorted nor shuffled.
    """
    resolved, qualified, plain, targets = _meant(dependencies, symbols, files)
    slices = lambda n: F.ceil(F.col(n) / SLICE)
    asking = plain.where("dependency_type <> 'contains'").select("id", *_EDGE, "o_group", "taken", F.explode(F.sequence(F.lit(0).cast("long"), slices("count") - 1)).alias("slice"))
    # few bytes become many rows here, so tasks are not merged by their bytes
    spark = dependencies.sparkSession
    asking = asking.repartition(max(cores(spark) * WAVES, int(spark.conf.get("spark.sql.shuffle.partitions"))), "member", "o_group", "slice")
    sliced = targets.select("n", "g", "m_id", F.pmod(F.xxhash64("m_id"), slices("of_name")).alias("of_slice"))
    every = asking.join(sliced, (F.col("member") == F.col("n")) & (F.col("o_group") == F.col("g")) & (F.col("slice") == F.col("of_slice"))).where(_NEW)
    every = every.select("id", "from_symbol_id", F.col("m_id").alias("to_id"), "dependency_type", "line_number", F.lit("name").alias("strategy"))
    out = resolved.unionByName(qualified).unionByName(_contained(plain, targets)).unionByName(every)
    return out.select("id", F.col("from_symbol_id").alias("from_id"), "to_id", F.col("dependency_type").alias("kind"), "line_number", "strategy")


def edge_counts(dependencies: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """How many edges build_edges gives by kind and strategy: kind, strategy, edges.

    Edges of plain names are counted by the number of symbols of the name and not written out.
    """
    resolved, qualified, plain, targets = _meant(dependencies, symbols, files)
    written = resolved.unionByName(qualified).unionByName(_contained(plain, targets)).select("dependency_type", "strategy", F.lit(1).cast("long").alias("n"))
    itself = F.col("o_name").eqNullSafe(F.col("member")).cast("long")
    counted = plain.where("dependency_type <> 'contains'").select("dependency_type", F.lit("name").alias("strategy"), (F.col("count") - itself - F.coalesce(F.array_size("taken"), F.lit(0))).alias("n"))
    found = written.unionByName(counted).groupBy(F.col("dependency_type").alias("kind"), "strategy").agg(F.sum("n").alias("edges"))
    return found.where("edges > 0")


def autoloaded(names: DataFrame, mappings: DataFrame) -> DataFrame:
    """Files that class names mean under autoloading rules, the longest prefix first: name, path.

    names: name. mappings: prefix, folder; a prefix ends with its separator
    (a backslash, a dot or a slash) or stands for a whole path such as @/*.
    Prefixes of names are few, so the rules meet them by equality.
    """
    n = names.select("name").where("name is not null").distinct()
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.col("name").substr(F.lit(1), i)), lambda p: p.rlike(r"[\\./]$"))
    prefixes = n.select("name", F.explode_outer(cuts).alias("prefix_"))
    rules = mappings.select(F.regexp_replace("prefix", r"\*$", "").alias("rule"), F.regexp_replace("folder", r"\*$", "").alias("folder"))
    hit = prefixes.join(rules, F.col("prefix_") == F.col("rule"))
    best = hit.groupBy("name").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "folder")).alias("k"))
    rest = F.col("name").substr(F.length("k.rule") + 1, F.length("name"))
    return best.select("name", F.concat(F.regexp_replace("k.folder", "/$", ""), F.lit("/"), F.regexp_replace(rest, r"[\\.]", "/")).alias("path"))


def virtual_symbols(imports: DataFrame) -> DataFrame:
    """Symbols for packages that imports name and no file holds: id (negative, by a hash of the name), name, symbol_type, importers."""
    outside = imports.where(~F.col("source").rlike(r"^(\.|@/|src/|/)"))
    package = F.regexp_extract("source", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return (
        outside.groupBy(package.alias("name"))
        .agg(F.count_distinct("file_id").alias("importers"))
        .select((-F.abs(F.xxhash64("name") % F.lit(2**62)) - 1).alias("id"), "name", F.lit("external").alias("symbol_type"), "importers")
    )


def route_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes with the method that handles them: the class by name or by the end of its qualified name, then its member.

    routes: file_id, method, path, handler as written ([C::class, 'm'], 'C@m' or c.m).
    """
    written = F.col("handler")
    owner = F.coalesce(*[F.nullif(F.regexp_extract(written, p, 1), F.lit("")) for p in (r"([\w\\]+)::class", r"['\"]([\w\\]+)@\w+", r"^(\w+)\.\w+$")])
    member = F.coalesce(*[F.nullif(F.regexp_extract(written, p, 1), F.lit("")) for p in (r"::class\s*,\s*['\"](\w+)", r"@(\w+)", r"\.(\w+)$")], F.lit("__invoke"))
    asked = routes.withColumns({"owner": F.lower(F.substring_index(owner, "\\", -1)), "member": member})
    c = symbols.where("symbol_type = 'class' and name is not null").groupBy(F.lower("name").alias("c_name")).agg(F.min("id").alias("class_id"))
    m = symbols.where("symbol_type = 'method' and name is not null").groupBy("parent_symbol_id", F.col("name").alias("m_name")).agg(F.min("id").alias("handler_id"))
    hit = asked.join(c, F.col("owner") == F.col("c_name"), "left").join(m, (F.col("class_id") == F.col("parent_symbol_id")) & (F.col("member") == F.col("m_name")), "left")
    return hit.select("file_id", "method", "path", "handler", "class_id", "handler_id")
