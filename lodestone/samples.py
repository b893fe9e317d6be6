"""Small files of our own, one for each way of chunking."""

FILES = {
    "pkg/tool.py": '''"""Tools."""
import os

LIMIT = 3


@cached
def small(a):
    return a


class Box:
    def get(self):
        return self.v

    @property
    def size(self):
        return 1

    def tiny(self): return 0


def long(a, b):
    x = a
    y = b
    for i in range(3):
        x += i
    z = x + y
    return z
''',
    "pkg/broken.py": "import sys\nprint 'old'\ndef f(a):\n    return a\n\nclass A:\n    def m(self):\n        pass\n",
    "proofs/Basic.lean": """import Init

/-- The first
/- nested -/ thing. -/
@[simp]
def one : Nat := 1

-- about two
private theorem two : one = 1 := rfl
structure P where
  x : Nat

instance : Inhabited P := ⟨⟨0⟩⟩
lemma last (p : P) : p = p := by
  -- a Monad is here
  rfl
""",
    "web/app.js": "// start\nimport a from 'a';\n\nfunction go(x) {\n  return { x };\n}\n\nclass View {\n  constructor(m) {\n    this.m = m;\n  }\n  draw() {\n    return this.m;\n  }\n}\n",
    "core/lib.rs": "use std::io;\n\npub struct Point {\n    x: i32,\n}\n\nimpl Point {\n    pub fn new() -> Self {\n        Point { x: 1 }\n    }\n\n    fn x(&self) -> i32 {\n        self.x\n    }\n}\n\nfn main() {\n    println!(\"}\");\n}\n",
    "notes/read.md": "intro line\n\n# First\ntext\n\n# Second\nmore\nwith gap here\n\nand\nmore\n\nlines\nto\nsplit\n\nend\n",
    "notes/plain.txt": "one\ntwo\n\nthree\n\nfour\nfive\nsix\nseven\neight\n\nnine\n",
}
