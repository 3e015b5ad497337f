"""Files by Spark's own file systems, so that any path that Spark can read will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark._sc._gateway, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)

    def at(self, *names: str):
        out = self.path
        for n in names:
            out = self.jvm.org.apache.hadoop.fs.Path(out, n)
        return out

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.at(*names))

    def names(self) -> list[tuple[str, bool]]:
        """Sorted names in the folder, with whether each is a folder; none if it isn't there."""
        if not self.exists():
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in self.fs.listStatus(self.path))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file by way of a neighbour, so that readers find the old or the new one."""
        neighbour = self.at(f"{name}.new")
        stream = self.fs.create(neighbour, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf).rename(neighbour, self.at(name), options)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def move_to(self, other: "Files") -> None:
        if not self.fs.rename(self.path, other.path):
            raise OSError(f"can't rename {self.path} to {other.path}")

    def replace_by(self, stage: "Files", aside: "Files") -> None:
        """Put `stage` in the place of this folder, which stands aside meanwhile and comes back if that fails."""
        held = self.exists()
        if held:
            self.move_to(aside)
        try:
            stage.move_to(self)
        except BaseException:
            if held:
                aside.move_to(self)
            raise
        if held:
            aside.delete()

    def encoded(self, name: str) -> str:
        """A file's name as Spark's metadata column has it."""
        return self.at(name).toUri().getRawPath().split("/")[-1]
