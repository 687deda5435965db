"""Closed vocabularies: fixed values that results depend on."""

# Entity types with allowed name prefixes, least number of observations and required keys.
ENTITY_RULES: dict[str, tuple[str, int, str]] = {
    "biz-domain": ("BIZ", 4, "WHAT TARGET REVENUE STARTED"),
    "biz-rule": ("RULE BIZ", 4, "RULE CONTEXT VIOLATION FILES"),
    "biz-flow": ("FLOW BIZ", 4, "FLOW TRIGGER SIDE_EFFECTS EDGE_CASE"),
    "biz-entity": ("ENTITY BIZ", 3, "FIELDS STATUSES CONSTRAINTS"),
    "pattern-code": ("PATTERN", 4, "WHAT WHEN HOW USED_IN"),
    "pattern-arch": ("PATTERN", 4, "WHAT WHEN HOW TRADEOFF"),
    "pattern-integration": ("PATTERN", 5, "SERVICE AUTH CALLBACK GOTCHA RETRY"),
    "tech-stack": ("TECH", 4, "FRONTEND BACKEND INFRA CI_CD"),
    "tech-config": ("TECH", 3, "ENV URLS CREDENTIALS_HINT"),
    "tech-person": ("TECH PERSON", 3, "ROLE PROJECTS PREFERENCES"),
    "tech-decision": ("TECH DECISION", 5, "DECISION REASON TRADEOFF ALTERNATIVES DATE"),
    "incident-bug": ("INCIDENT", 6, "SYMPTOM ROOT_CAUSE FIX FILES TIME PROJECT"),
    "incident-gotcha": ("GOTCHA INCIDENT", 4, "WHAT IMPACT FIX APPLIES_TO"),
}
# Relation types.
RELATION_TYPES = (
    "has_rule has_flow has_entity uses_tech uses_pattern leads works_on reviews decided used_in extends alternative_to found_in applies_to decided_for depends_on triggers part_of input_to output_of "
    "uses implements implemented_by affects integrates_with contains enforces enforced_by has_architecture inspired-by configured_by supersedes documents has_data_model complements applied_in owns governs "
    "governed_by has_incident feeds_into informs member_of built_with implements_types has_module involves resolves validates"
).split()
# Pairs of entity types between which a relation may be missing.
TYPE_PAIRS = (
    "biz-domain|biz-rule biz-domain|biz-flow biz-domain|biz-entity biz-flow|biz-rule biz-entity|biz-rule biz-entity|biz-flow biz-flow|incident-bug biz-entity|incident-bug biz-rule|incident-bug "
    "biz-flow|incident-gotcha biz-entity|incident-gotcha incident-bug|pattern-code incident-bug|tech-stack incident-gotcha|pattern-code incident-gotcha|tech-stack pattern-arch|pattern-code "
    "pattern-code|tech-stack pattern-arch|tech-stack pattern-arch|pattern-integration pattern-integration|tech-stack tech-decision|tech-stack pattern-arch|tech-decision tech-config|tech-stack "
    "biz-domain|tech-stack biz-domain|pattern-arch"
).split()
# Segments of names that say nothing about their scope.
MODIFIERS = ["arch", "code", "int", "integration", "decision", "person", "config", "stack", "biz", "tech", "rule", "flow", "entity", "incident", "gotcha"]
# Allowed moves between lifecycles and between states of a fault.
LIFECYCLE_MOVES = {"candidate": "active rejected archived", "active": "archived", "archived": "active", "rejected": "candidate"}
FAULT_MOVES = {
    "NEW": "ACKNOWLEDGED IGNORED",
    "ACKNOWLEDGED": "INVESTIGATING IGNORED",
    "INVESTIGATING": "FIXED_PENDING_VERIFY IGNORED",
    "FIXED_PENDING_VERIFY": "VERIFIED_FIXED INVESTIGATING",
    "VERIFIED_FIXED": "CLOSED REGRESSED",
    "CLOSED": "REGRESSED",
    "IGNORED": "ACKNOWLEDGED",
    "REGRESSED": "INVESTIGATING IGNORED",
}
# Stop words of exact-token search.
SEARCH_STOP = (
    "the a an is are was were be been being am have has had do does did will would could should may might shall can to of in for on with at by from as into out up down over under through and but or nor "
    "not no so if then than that this these those it its we you they them their all any each every both few more most other some such too very just about also only here there what which when where why how who "
    "và là của có không được cho với này đó các những một khi thì mà nên đã sẽ đang bị bởi từ đến trong ngoài trên dưới vào ra rồi nữa cũng vẫn còn phải nếu vì nhưng hoặc theo về tại sau trước giữa cùng như "
    "rất quá hơn nhất bạn tôi mình chúng họ ai gì sao đâu nào"
).split()
# Stop words of the quality checks.
QUALITY_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through during before after above below between and but "
    "or not no all each every both few more most other some such than too very just about min max new old use used using"
).split()
# Words that carry nothing in a skill query.
SKILL_NOISE = "help me please want need how to do i a the".split()
# Texts near the start of a tool's output that mark a failed call.
ERROR_MARKERS = ["Cannot read properties of", "is not a function", "is not defined", "ENOENT", "ECONNREFUSED", "Traceback (most recent call last)", "MCP error -", "Tool execution failed"]
# Tools that the small profile offers.
CORE_TOOLS = ["query", "context", "impact", "detect_changes", "index", "semantic_search", "search_nodes", "open_nodes", "create_entities", "add_observations", "create_relations", "unified_search", "session_start", "health"]
# What is let through when metadata of a fault is stored.
FAULT_COMPONENTS = "runtime search storage model setup hook mcp cli scan diagnostics code-index bridge".split()
FAULT_PHASES = "startup import open initialize ready request background shutdown rollback".split()
FAULT_CATEGORIES = "internal expected dependency timeout cancelled".split()
# Words that make a prompt worth a look into the store.
CODE_WORDS = (
    "function class method import export require module api route endpoint handler controller service auth login token session jwt oauth db sql query schema table migration index component hook middleware plugin "
    "adapter refactor rename extract inline test spec suite fixture bug fix issue error crash stack deploy build ci cd pipeline react vue next express fastify nestjs laravel django payment billing subscription "
    "checkout invoice"
).split()
KNOWLEDGE_WORDS = "rule flow decision architecture pattern business requirement spec contract invariant incident gotcha lesson tradeoff recall remember memory brain".split()
