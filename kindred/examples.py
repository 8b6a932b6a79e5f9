"""Small sources in each language with the regions of two lines or more that chunkers find in them."""

#: language -> (source, [(start_line, end_line, chunk_type, name, context)]).
CASES = {
    "python": ("class A:\n    def f(self):\n        return 1\n\nasync def g():\n    x = 1\n    return x\n", [(1, 3, "class", "A", ""), (2, 3, "method", "f", "class A"), (5, 7, "function", "g", "")]),
    "java": ('class A {\n  A(int x) {\n    y = x;\n  }\n  public int f(int a) {\n    if (a > 1) {\n      return "}";\n    }\n    return 2;\n  }\n}\n', [(2, 4, "constructor", "A", "class A"), (5, 10, "method", "f", "class A")]),
    "go": ("func (r *T) Do(a int) error {\n  return nil\n}\n\nfunc Main() {\n  x()\n}\n", [(1, 3, "method", "Do", "type T"), (5, 7, "function", "Main", "")]),
    "rust": ("trait T {\n  fn a(&self) -> i32 {\n    1\n  }\n}\nmod m {\n fn b() {\n  2;\n }\n}\nfn c() {\n 3;\n}\n", [(2, 4, "method", "a", "trait T"), (7, 9, "method", "b", "mod m"), (11, 13, "function", "c", "")]),
    "javascript": ("class A {\n  foo(a) {\n    return a;\n  }\n}\nfunction b() {\n  return 1;\n}\nconst c = (x) => {\n  return x;\n};\nconst o = { d: function () {\n return 2;\n} };\n", [(2, 4, "method", "foo", "class A"), (6, 8, "function", "b", ""), (9, 11, "arrow_function", "c", ""), (12, 14, "function", "d", "")]),
    "typescript": ("class A {\n  foo(a: number): string {\n    return a;\n  }\n}\n", [(2, 4, "method", "foo", "class A")]),
    "cpp": ("namespace n {\nclass A {\n  int f() {\n    return 1;\n  }\n};\nenum class E {\n a,\n b };\n}\nint main() {\n  return 0;\n}\n", [(2, 6, "class", "A", "namespace n"), (7, 9, "enum", "E", "namespace n"), (11, 13, "function", "main", "")]),
    "c": ("struct S {\n int a;\n};\nstatic int f(int a) {\n  return a; // }\n}\n", [(1, 3, "struct", "S", ""), (4, 6, "function", "f", "")]),
    "swift": ("class A {\n  init(a: Int) {\n    self.a = a\n  }\n  func f() -> Int {\n    return 1\n  }\n  var x: Int {\n    return 2\n  }\n}\n", [(2, 4, "initializer", "init", "class A"), (5, 7, "method", "f", "class A"), (8, 10, "computed_property", "x", "class A")]),
    "kotlin": ("class A {\n  fun f(a: Int): Int {\n    return a\n  }\n  companion object {\n    fun g() {\n      h()\n    }\n  }\n}\n", [(2, 4, "method", "f", "class A"), (6, 8, "method", "g", "class A.companion")]),
    "csharp": ("namespace N {\n  class A {\n    public A() {\n      x = 1;\n    }\n  }\n}\n", [(2, 6, "class", "A", "namespace N")]),
    "php": ("<?php\nnamespace X;\nclass Y {\n  function f($a) {\n    return $a;\n  }\n}\n", [(3, 7, "class", "Y", "namespace X"), (4, 6, "method", "f", "namespace X::class Y")]),
    "ruby": ("module M\n  class A\n    def f(x)\n      if x\n        1\n      end\n    end\n    def self.g\n      2\n    end\n  end\nend\n", [(1, 12, "module", "M", ""), (2, 11, "class", "A", "module M"), (3, 7, "method", "f", "class A"), (8, 10, "class_method", "g", "class A")]),
    "lua": ("local function f(a)\n  if a then\n    return 1\n  end\nend\nfunction M.g()\n  return 2\nend\n", [(1, 5, "local_function", "f", ""), (6, 8, "function", "M.g", "")]),
    "bash": ('f() {\n  echo a\n}\nfunction g {\n  echo "}"\n}\n', [(1, 3, "function", "f", ""), (4, 6, "function", "g", "")]),
    "scala": ("object O {\n  def f(x: Int): Int = {\n    x\n  }\n}\n", [(2, 4, "method", "f", "object O")]),
}

#: Bodies without blocks, and code with errors.
BODIES = {
    "kotlin": ("fun total(xs: List<Int>): Int =\n    xs\n        .map { it * 2 }\n        .sum()\n\nclass A {\n    val f by lazy {\n        one()\n        two()\n    }\n    fun g() {\n        if (x) {\n            y()\n        }\n    }\n}\n", [(1, 4, "function", "total", ""), (7, 10, "lambda", None, "class A"), (11, 15, "method", "g", "class A")]),
    "scala": ("package p\n\nclass A(x: Int):\n  def f(y: Int): Int =\n    val z = y\n    z * 2\n\n  val t = Map(\n    1 -> 2\n  )\n\nobject B {\n  def g(a: Int = 1) = {\n    a\n  }\n}\n", [(4, 6, "method", "f", "package p.class A"), (8, 10, "val", "t", "package p.class A"), (13, 15, "method", "g", "package p.object B")]),
    "swift": ("struct A {\n    let items = [\n        1,\n        2\n    ]\n    var n: Int {\n        let q = 1\n        return q\n    }\n}\n", [(2, 5, "computed_property", "items", "struct A"), (6, 9, "computed_property", "n", "struct A")]),
    "javascript": ("const f = (a, b) =>\n  a.map(x => x + 1)\n    .length;\n\nconst o = {\n  m: x =>\n    x +\n    1,\n};\nconst t = async (a) => {\n  b();\n};\n", [(1, 3, "arrow_function", "f", ""), (6, 8, "arrow_function", "m", ""), (10, 12, "arrow_function", "t", "")]),
    "python": ("class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return (1\n\ndef h(a):\n    def inner():\n        return 2\n    return inner\n\nprint 'old'\n", [(1, 6, "class", "A", ""), (2, 3, "method", "f", "class A"), (5, 6, "method", "g", "class A"), (8, 11, "function", "h", "")]),
}
