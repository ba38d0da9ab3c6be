"""Texts labelled by hand before the model saw them, in the form of ``pii_examples``; none was used to tune it."""

HELD_OUT = (
    "[n:Oriel Thackeray]\nPhone: [p:+44 1632 960 881]\n[e:oriel.thackeray@quay.example]\n\nRan the Stone Gate project at Meridian Software with 4 colleagues.",
    "Resume of [n:Priscilla van Aarden]\nID card: [i:F55021934]\n[s:71 Cobbler Lane, Westmark]\n\nUsed Spark and Hadoop daily; version 3.5.1; ticket 11-204-98.",
    "[n:Denholm, Faye]  [p:(415) 555-0118]\n\nFront End Developer at Larkspur Media. Invoice 90211 445 03 was mine.",
    "I am [n:Anouk Delacroix-Wren]. SSN: [i:908-55-0132]. Mail me: [e:anouk [at] delacroix [dot] example].",
    "[n:Sören Hallqvist]\nQA Lead\nTelefon [p:030 5550 1477]\n[s:Birkenweg 22, 50667 Köln]\n\nReported to [n:Marit Engelstad] from Polar Analytics.",
    "My name is [n:Tomasz Wilkowyja]. Mobile [p:07700 900 552]. Passport: [i:AB4409217].\n\nPresented a talk at Cloud Days; taught Rust to the Delta team.",
    "Referee - [n:G. Apfelbaum], Quillfeather Group, [p:+1 646 555 0102].\n\nMoved 12 million rows from Oracle to Snowflake. Page 14 of 22.",
    "Emergency contact: [n:Lubov Karenska], Tidemark Labs. Build 2022.10.4, release 18, host 10.0.4.17.",
    "Regards,\n[n:Caspian Rourke]\n\n[n:Caspian Rourke] managed the Night Train service; [n:Rourke] trained 9 analysts.",
    "[n:Hedda Vinterberg], [s:15 Harbour Road, 4021 Strand], tel: [p:+47 22 555 091], dni [i:55120987K]\n\nJunior Data Analyst at Saltmarsh Partners.",
    "DevOps Engineer\n[e:kim_li@forge.example] / [p:212-555-0161] / [s:402 Chestnut Ave]\n\nSee the Garden Street portal and the 12 Hill Road Bakery account.",
    "Reference: [n:Zebedee Crowhurst] of Palewater Studio. Dr. [n:Imke Osterhaus] advised me. Order 4410 2231 9087.",
    "Nombre: [n:Jimena Ortuño]\nNIE: [i:X7654321B]\n[s:Plaza de la Luna 3, 41001 Sevilla]\n\nCurso de Python y SQL en Instituto Alameda.",
    "Nom: [n:Corentin Le Gall]\nTél. inconnu\n[s:5 impasse du Port, 29200 Brest]\n\nProjet Vague Bleue; 2019-2023; version 11.0.2.",
    "[n:BALTHAZAR OKONJO]\nPlatform Architect\nFax: [p:(0161) 496 0775]\n\nWide Go and Elixir practice at Ember Institute.",
    "tax id: [i:914 220 687]\nWrite to [e:no.reply+jobs@hall.example].\n\nProduct Owner. Certified Kubernetes Administrator. Issue 77-310-45 closed.",
    "Supervised by [n:Ottilie Brandvold] and mentored by [n:Ruaridh Maclennan]. Class of 2015. Account 220 418 993 2.",
    "[n:Wilhelmina Drost]\nSupport Specialist\n\nKept Blue Lagoon online; led Operations Review; wrote Field Guide to Logs.",
)
