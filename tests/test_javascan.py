"""Declaration scanner shapes (pure Python, no Spark)."""

from legible.operators.javascan import mask, scan_java, split_params


def units(text):
    return {(r["unit_kind"], r["class_name"], r["method_name"]): r for r in scan_java("X.java", text)}


def test_shapes():
    src = '''package a.b;
public interface Api<T> {
    <R> R map(java.util.function.Function<T, R> f);
    default int[] sizes(String... names) { return new int[] {names.length}; }
    static Api<String> of(Map<String, List<Integer>> seed) throws IOException, InterruptedException { return null; }
}
record Pair(int left, int right) { Pair { if (left > right) throw new IllegalArgumentException(); } int sum() { return left + right; } }
class Texts { String t() { return """
    a { b } " c
    """; } char c() { return '{'; } }
'''
    u = units(src)
    m = u[("method", "Api", "map")]
    assert m["param_types"] == ["java.util.function.Function<T, R>"] and m["return_type"] == "R" and m["code"] == ""
    s = u[("method", "Api", "sizes")]
    assert s["param_types"] == ["String..."] and s["param_names"] == ["names"] and s["return_type"] == "int[]"
    o = u[("method", "Api", "of")]
    assert o["param_types"] == ["Map<String, List<Integer>>"] and o["throws"] == ["IOException", "InterruptedException"]
    assert ("method", "Pair", "sum") in u and u[("type", "Pair", "")]["type_kind"] == "record"
    assert ("method", "Texts", "t") in u and ("method", "Texts", "c") in u
    assert u[("type", "Api", "")]["type_kind"] == "interface" and u[("type", "Api", "")]["n_members"] == 3


def test_mask_keeps_offsets():
    t = 'a = "{"; // }\n/* { */ b'
    m = mask(t)
    assert len(m) == len(t) and "{" not in m and "}" not in m and m.endswith("b")


def test_split_params():
    assert split_params("final Map<K, V> m, @Nullable int[] xs, String... rest") == [
        ("Map<K, V>", "m"), ("int[]", "xs"), ("String...", "rest")]


def test_unbalanced_is_quarantined():
    r = scan_java("B.java", "class B { void f() { }")
    assert len(r) == 1 and r[0]["unit_kind"] == "error"


def test_scan_frames_are_bounded():
    """A batch of many files comes out in frames of bounded size, every declaration once."""
    import pandas as pd
    from legible.operators import javascan
    files = pd.DataFrame({"rel_path": ["F%d.java" % i for i in range(1500)],
                          "text": ["class F%d { int a() { return 1; } void b(int x) { } }" % i for i in range(1499)] + [None]})
    frames = list(javascan.scan_partitions([files]))
    assert max(map(len, frames)) <= javascan.FRAME_ROWS + 3
    rows = pd.concat([f for f in frames if len(f)])
    assert len(rows) == 1499 * 3 and rows["file"].nunique() == 1499
    big = pd.DataFrame({"rel_path": ["a", "b", "c"], "text": ["class A { /* %s */ }" % ("x" * javascan.FRAME_CHARS)] * 3})
    assert [len(f) for f in javascan.scan_partitions([big]) if len(f)] == [1, 1, 1]
