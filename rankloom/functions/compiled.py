"""Functions of the JVM: Java source, compiled by the compiler that Spark generates code with, sent to the executors as a jar."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Levenshtein distance of whole texts by code points, 64 rows of the table in a word, 256 words of rows at a time. A strip of rows is
#: carried over all columns and leaves the differences of its last row, so memory is linear in a text and time is columns x words.
EDIT_DISTANCE = """
package rankloom;

public final class EditDistance implements org.apache.spark.sql.api.java.UDF2 {
  private static final long serialVersionUID = 1L;
  static final int WORDS = 256;

  public Object call(Object a, Object b) {
    if (a == null || b == null) return null;
    return Long.valueOf(distance(((String) a).codePoints().toArray(), ((String) b).codePoints().toArray()));
  }

  static long distance(int[] a, int[] b) {
    int start = 0, aEnd = a.length, bEnd = b.length;
    while (start < aEnd && start < bEnd && a[start] == b[start]) start++;
    while (aEnd > start && bEnd > start && a[aEnd - 1] == b[bEnd - 1]) { aEnd--; bEnd--; }
    if (aEnd == start || bEnd == start) return (long) (aEnd - start) + (bEnd - start);
    if (aEnd < bEnd) { int[] t = a; a = b; b = t; int e = aEnd; aEnd = bEnd; bEnd = e; }
    int columns = bEnd - start;
    byte[] carried = new byte[columns];
    java.util.Arrays.fill(carried, (byte) 1);
    long found = columns;
    long[] up = new long[WORDS], down = new long[WORDS], none = new long[WORDS];
    for (int from = start; from < aEnd; from += Math.min(64 * WORDS, aEnd - from)) {
      int rows = Math.min(64 * WORDS, aEnd - from), words = (rows + 63) >>> 6;
      long[][] ascii = new long[128][];
      java.util.HashMap others = new java.util.HashMap();
      for (int i = 0; i < rows; i++) {
        int c = a[from + i];
        long[] held = c < 128 ? ascii[c] : (long[]) others.get(Integer.valueOf(c));
        if (held == null) {
          held = new long[words];
          if (c < 128) ascii[c] = held; else others.put(Integer.valueOf(c), held);
        }
        held[i >>> 6] |= 1L << (i & 63);
      }
      java.util.Arrays.fill(up, -1L);
      java.util.Arrays.fill(down, 0L);
      for (int j = 0; j < columns; j++) {
        int c = b[start + j];
        long[] held = c < 128 ? ascii[c] : (long[]) others.get(Integer.valueOf(c));
        carried[j] = (byte) column(held == null ? none : held, up, down, words, carried[j]);
      }
      for (int w = 0; w < words; w++) {
        long kept = w == words - 1 && (rows & 63) != 0 ? (1L << (rows & 63)) - 1 : -1L;
        found += Long.bitCount(up[w] & kept) - Long.bitCount(down[w] & kept);
      }
    }
    return found;
  }

  /** One column of a strip; given and returned: 1 if the row above, or the last, grows by one in this column, 2 if it falls. */
  static int column(long[] held, long[] up, long[] down, int words, int carry) {
    long right = carry & 1, left = carry >>> 1;
    for (int w = 0; w < words; w++) {
      long p = up[w], n = down[w], same = held[w] | left;
      long level = (((same & p) + p) ^ p) | same | n;
      long r = n | ~(level | p), l = p & level;
      long shiftedR = r << 1 | right, shiftedL = l << 1 | left;
      right = r >>> 63;
      left = l >>> 63;
      up[w] = shiftedL | ~(level | shiftedR);
      down[w] = shiftedR & level;
    }
    return (int) (right | left << 1);
  }
}
"""

_made: dict[str, object] = {}


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two strings as a long, null where one is."""
    return _function("rankloom_edit_distance", "rankloom.EditDistance", EDIT_DISTANCE, a, b)


def _function(name: str, class_name: str, source: str, *args: Column) -> Column:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    sc = spark.sparkContext
    key = f"{sc.applicationId}/{name}"
    if key not in _made:
        _made[key] = _compiled(sc, class_name, source)
    kind = sc._jvm.org.apache.spark.sql.types.DataType.fromDDL("bigint")
    spark._jsparkSession.udf().register(name, _made[key], kind)
    return F.call_function(name, *args)


def _compiled(sc, class_name: str, source: str):
    """An instance of the class; its jar is written by the driver and fetched from there by the executors, as any jar of a session is."""
    compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    classes = compiler.getBytecodes()
    path = os.path.join(tempfile.mkdtemp(prefix="rankloom-"), f"{hashlib.sha256(source.encode()).hexdigest()[:16]}.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for c in classes:
            jar.writestr(c.replace(".", "/") + ".class", bytes(classes[c]))
    sc._jsc.addJar(path)
    found = compiler.getClassLoader().loadClass(class_name)
    return found.getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0))
