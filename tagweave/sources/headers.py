"""Image headers as a Python Data Source: size and colour mode without decoding a pixel.

``spark.dataSource.register(image_headers()); spark.read.format("image_headers").load(folder)``

Each task opens its files and reads as far as the header goes, a few dozen bytes for most formats. The classes are made inside
a function, so that executors get them by value and need not have this package.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, width int, height int, mode string, has_transparency boolean"
#: Files that one task looks into.
FILES_EACH = 500


def image_headers() -> type[DataSource]:
    """The data source class; options ``path``, ``recursive`` (false) and ``filesEach``."""
    schema, each = SCHEMA, FILES_EACH

    class Cut(Exception):
        """The file ends before its header does, or holds something else."""

    class Source:
        """Bytes at any place of a file."""

        def __init__(self, file):
            self.file = file

        def at(self, offset: int, length: int) -> bytes:
            self.file.seek(offset)
            found = self.file.read(length)
            if len(found) < length:
                raise Cut
            return found

    def number(data: bytes, order: str = "big") -> int:
        return int.from_bytes(data, order)

    def png(source: Source) -> tuple:
        head = source.at(16, 10)
        depth, kind = head[8], head[9]
        modes = {0: {1: "1", 16: "I;16"}.get(depth, "L"), 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
        if kind not in modes:
            raise Cut
        at, clear = 8, kind in (4, 6)
        while not clear:  # a palette's transparency stands between the header and the pixels
            length, name = number(source.at(at, 4)), source.at(at + 4, 4)
            if name in (b"IDAT", b"IEND"):
                break
            clear, at = name == b"tRNS", at + length + 12
        return number(head[:4]), number(head[4:8]), modes[kind], clear

    def jpeg(source: Source) -> tuple:
        at = 2
        while True:
            marker = source.at(at, 2)
            if marker[0] != 0xFF:
                raise Cut
            if marker[1] == 0xFF:  # filling
                at += 1
            elif marker[1] in range(0xC0, 0xD0) and marker[1] not in (0xC4, 0xC8, 0xCC):
                size = source.at(at + 5, 5)
                mode = {1: "L", 3: "RGB", 4: "CMYK"}.get(size[4])
                return number(size[2:4]), number(size[:2]), mode, False
            elif marker[1] in (0xD9, 0xDA):
                raise Cut
            else:
                at += 2 + (0 if marker[1] in range(0xD0, 0xD9) or marker[1] == 1 else number(source.at(at + 2, 2)))

    def gif(source: Source) -> tuple:
        head = source.at(6, 5)
        width, height, flags = number(head[:2], "little"), number(head[2:4], "little"), head[4]
        at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        while source.at(at, 1) == b"!":
            if source.at(at + 1, 1) == b"\xf9":
                return width, height, "P", bool(source.at(at + 3, 1)[0] & 1)
            at += 2
            while size := source.at(at, 1)[0]:
                at += size + 1
            at += 1
        return width, height, "P", False

    def bmp(source: Source) -> tuple:
        size = number(source.at(14, 4), "little")
        if size == 12:
            head = source.at(18, 8)
            return number(head[:2], "little"), number(head[2:4], "little"), "P" if number(head[6:8], "little") <= 8 else "RGB", False
        head = source.at(18, 12)
        width, height = (int.from_bytes(head[i : i + 4], "little", signed=True) for i in (0, 4))
        bits = number(head[10:12], "little")
        alpha = bits == 32 and size >= 56 and number(source.at(66, 4), "little") != 0
        return width, abs(height), "P" if bits <= 8 else "RGBA" if alpha else "RGB", alpha

    def webp(source: Source) -> tuple:
        kind = source.at(12, 4)
        if kind == b"VP8X":
            head = source.at(20, 10)
            alpha = bool(head[0] & 0x10)
            width, height = number(head[4:7], "little") + 1, number(head[7:10], "little") + 1
        elif kind == b"VP8L":
            bits = number(source.at(21, 4), "little")
            width, height, alpha = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
        elif kind == b"VP8 " and source.at(23, 3) == b"\x9d\x01\x2a":
            head = source.at(26, 4)
            width, height, alpha = number(head[:2], "little") & 0x3FFF, number(head[2:], "little") & 0x3FFF, False
        else:
            raise Cut
        return width, height, "RGBA" if alpha else "RGB", alpha

    def header(source: Source) -> tuple:
        """Width, height, mode and transparency; all None where no header can be read."""
        try:
            start = source.at(0, 12)
            if start[:8] == b"\x89PNG\r\n\x1a\n":
                return png(source)
            if start[:2] == b"\xff\xd8":
                return jpeg(source)
            if start[:6] in (b"GIF87a", b"GIF89a"):
                return gif(source)
            if start[:2] == b"BM":
                return bmp(source)
            if start[:4] == b"RIFF" and start[8:] == b"WEBP":
                return webp(source)
        except Cut:
            pass
        return None, None, None, None

    class Files(InputPartition):
        def __init__(self, files: list[tuple[str, int]]):
            super().__init__(None)
            self.files = files

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.folder = options["path"]
            self.recursive = options.get("recursive", "false").lower() == "true"
            self.each = int(options.get("filesEach", each))

        def _system(self):
            from pyarrow import fs

            folder = self.folder
            if folder.startswith("file:/") and not folder.startswith("file://"):
                folder = "file://" + folder.removeprefix("file:")
            return fs.FileSystem.from_uri(folder)

        def partitions(self):
            from pyarrow import fs

            system, folder = self._system()
            found = system.get_file_info(fs.FileSelector(folder, recursive=self.recursive))
            files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
            return [Files(files[i : i + self.each]) for i in range(0, len(files), self.each)] or [Files([])]

        def read(self, partition):
            system, folder = self._system()
            scheme = self.folder.split(":", 1)[0] + "://" if "://" in self.folder and not self.folder.startswith("file:") else "file:"
            for path, length in partition.files:
                with system.open_input_file(path) as file:
                    yield scheme + path, length, *header(Source(file))

    class ImageHeaders(DataSource):
        @classmethod
        def name(cls):
            return "image_headers"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return ImageHeaders
