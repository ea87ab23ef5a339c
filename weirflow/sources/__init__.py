"""Sources and sinks."""

from .files import Collect, ReadFromFile, ReadFromHDFS, ReadTable, WriteTable, WriteToDisk, WriteToFile
from .streams import Drain, ReadFromSocket, ReadFromStdIn, ReadStream, WriteToStdOut, frames, spool, spooled

__all__ = ["Collect", "Drain", "ReadFromFile", "ReadFromHDFS", "ReadFromSocket", "ReadFromStdIn", "ReadStream", "ReadTable", "WriteTable", "WriteToDisk", "WriteToFile", "WriteToStdOut", "frames", "spool", "spooled"]
