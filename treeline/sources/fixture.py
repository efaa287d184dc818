"""``source_files`` derived from the ``documents`` table (FIXTURES.md, section 4).

Every column is a pure string expression of ``doc_id`` and ``text``, so the
rows grow with the table and SQL can build the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIR = """
  case ({d} div 4) % 10
    when 0 then 'node_modules/m0' when 1 then 'tests/m1' when 2 then 'src/test/java/m2'
    else concat('src/m', ({d} div 4) % 10) end
"""


def _directory(d: str) -> str:
    return _DIR.format(d=f"({d})")


def _dotted(d: str) -> str:
    return f"concat(replace({_directory(d)}, '/', '.'), '.u', {d})"


def _slashed(d: str) -> str:
    return f"concat({_directory(d)}, '/u', {d})"


def _imports(one) -> str:
    return f"""concat({one('doc_id - 4')},
      case when (doc_id div 4) % 5 = 0 then {one('doc_id + 4')} else '' end)"""


def _python() -> str:
    one = lambda d: f"concat('from ', {_dotted(d)}, ' import f', {d}, '\\n')"
    return f"""concat(
      'import os\\n', {_imports(one)},
      '# ', if(doc_id % 3 = 0, 'TODO', 'note'), '\\n',
      'def f', doc_id, '(x, y):\\n    s = "# no"\\n    if x and y:\\n        return s\\n',
      repeat('    elif x > 1:\\n        y = 1\\n', cast(doc_id % 20 as int)),
      '    else:\\n        return y\\n\\nclass C', doc_id, ':\\n    pass\\n',
      'def g', doc_id, '(a=k((1, (2,))),\\n        b=None):\\n    def inner(): return a or b\\n',
      '    return 1 if a else 2\\n', '# ', replace(text, '\\n', '\\n# '))"""


def _script(prefix: str) -> str:
    one = lambda d: f"concat('import f from \"{prefix}', {_slashed(d)}, '\";\\n')"
    return f"""concat(
      'const p = require("path");\\n', {_imports(one)},
      '// ', if(doc_id % 3 = 0, 'FIXME', 'note'), '\\n',
      'function f', doc_id, '(x, y) {{\\n  if (x && y) {{ return "// no"; }}\\n',
      repeat('  while (x > 1) {{ x--; }}\\n', cast(doc_id % 20 as int)),
      '  return y;\\n}}\\nclass C', doc_id, ' {{\\n}}\\n',
      'function g', doc_id, '(\\n  a,\\n  b\\n) {{\\n',
      '  for (let i = size(b) - 1; i >= 0; i--) {{ do {{ a--; }}            while (a > 0); }}\\n',
      '  const h = (p, q = k(k(1))) => p && q;\\n  return a;\\n}}\\n',
      '// ', replace(text, '\\n', '\\n// '))"""


def _java() -> str:
    one = lambda d: f"concat('import ', {_dotted(d)}, ';\\n')"
    return f"""concat(
      'import java.util.List;\\n', {_imports(one)},
      '/* ', if(doc_id % 3 = 0, 'HACK', 'note'), '\\n   more */\\n',
      'class C', doc_id, ' {{\\n  int f', doc_id, '(int x, int y) {{\\n',
      '    if (x > 0 && y > 0) {{ return x; }}\\n',
      repeat('    for (int i = 0; i < x; i++) {{ y++; }}\\n', cast(doc_id % 20 as int)),
      '    return y;\\n  }}\\n',
      '  public List<Map<String, List<String>>> g', doc_id, '(\\n      int a,\\n      List<? extends Object> b\\n',
      '  ) throws Exception {{\\n',
      '    for (int i = b.size() - 1; i >= 0; i--) {{ do {{ a--; }}            while (a > 0); }}\\n',
      '    return a > b.size() ? null : c(a);\\n  }}\\n}}\\n',
      '// ', replace(text, '\\n', '\\n// '))"""


def source_files(documents: DataFrame) -> DataFrame:
    """One synthetic file per document: ``repo, path, content``."""
    return documents.selectExpr(
        "'corpus' as repo",
        f"""concat({_directory('doc_id')}, '/u', doc_id,
          case doc_id % 4 when 0 then '.py' when 1 then '.js' when 2 then '.ts' else '.java' end
        ) as path""",
        f"""case doc_id % 4 when 0 then {_python()} when 1 then {_script('')}
          when 2 then {_script('../../')} else {_java()} end as content""",
    )


def read_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` of one test-data folder."""
    return source_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
