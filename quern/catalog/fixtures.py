"""Small sources and graphs written down here, for operators whose matter the test tables don't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: `path, lang, text`: one project in every language and framework that the code operators know.
FILES = [
    ("web/routes.js", "js", "import { show, list } from './handlers';\nrouter.get('/items/:id', show);\nrouter.post('/items', list);\napp.delete('/items/:id', missing);\n"),
    ("web/handlers.js", "js", "export function show(req) {\n  return load(req.id);\n}\nexport function list(req) {\n  return load(req.q);\n}\nfunction load(x) {\n  return x;\n}\n"),
    ("web/Card.jsx", "js", "import { useItem } from './hooks';\nexport function Card(props) {\n  const item = useItem(props.id);\n  return <Badge value={item} />;\n}\nexport function Badge(p) {\n  return p.value;\n}\n"),
    ("web/hooks.js", "js", "export function useItem(id) {\n  return id;\n}\nexport async function GET(request) {\n  return useItem(request.id);\n}\n"),
    ("api/items.service.ts", "js", "export class ItemService {\n  constructor(@Inject(STORE) store) {\n    this.store = store;\n  }\n  @Get('/health')\n  health() {\n    return 1;\n  }\n}\nexport const STORE = 'store';\n"),
    ("site/urls.py", "py", "from .views import home, Detail\nurlpatterns = [path('h/', views.home), path('d/', Detail)]\n"),
    ("site/views.py", "py", "class Base:\n    def get(self):\n        return render(self)\n\nclass Detail(Base):\n    def post(self):\n        return home(1)\n\ndef home(request):\n    return render(request)\n\ndef render(x):\n    return x\n"),
    ("site/app.py", "py", "@app.route('/ping')\ndef ping():\n    return pong()\n\ndef pong():\n    return 1\n"),
    ("src/Orders.java", "java", "package shop;\nimport shop.Store;\npublic class Orders extends Base implements Closing {\n  private int count = 0;\n  public void close() {\n    save();\n  }\n  public void save() {\n    count();\n  }\n}\n"),
    ("src/OrderMapper.xml", "mybatis", "<mapper namespace=\"shop.Orders\">\n<sql id=\"cols\">a, b</sql>\n<select id=\"find\"><include refid=\"cols\"/></select>\n</mapper>\n"),
    ("ui/UserCard.vue", "vue", "<template>\n<item-badge/>\n</template>\n<script>\nexport default {\n  name: 'UserCard',\n  methods: {\n    open(x) {\n    }\n  }\n}\n</script>\n"),
    ("ui/ItemBadge.vue", "vue", "<template><b/></template>\n"),
    ("ui/Panel.svelte", "svelte", "<script>\nexport let title;\nexport function ready(x) {\n  return x;\n}\n</script>\n<Panel2/>\n{#if ready(title)}ok{/if}\n"),
    ("ui/Panel2.svelte", "svelte", "<p/>\n"),
    ("snippets/price.liquid", "liquid", "<b>{{ price }}</b>\n"),
    ("sections/main.liquid", "liquid", "{% render 'price' %}\n{% render 'gone' %}\n"),
    ("app/routes.php", "php", "Route::get('/u', [UserController::class, 'index']);\nview('users.profile');\nCache::get('x');\n"),
    ("config/routes.rb", "rb", "get '/users' => 'users#entry'\nresources :orders\n"),
    ("broken.py", "py", "def (:\n"),
    ("empty.js", "js", ""),
]
#: `id, name, path, kind, parent, line, line_end` of symbols beside those of FILES, in languages that are not read here.
MORE_SYMBOLS = [
    ("app/UserController.php::UserController.index", "index", "app/UserController.php", "method", "UserController", 3, 9),
    ("resources/views/users/profile.blade.php::profile", "profile", "resources/views/users/profile.blade.php", "component", None, 1, 5),
    ("app/users_controller.rb::UsersController.entry", "entry", "app/users_controller.rb", "method", "UsersController", 2, 4),
    ("app/orders_controller.rb::OrdersController", "OrdersController", "app/orders_controller.rb", "class", None, 1, 9),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, lang string, text string")


def values(rows: list[tuple]) -> str:
    """Rows for SQL."""
    one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows)
